"""Column functions: the parametrised hash, colours, bit order, rounding, tile costs, differences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hash parameters and colour widths of the full report.
KS = range(3, 19)
WS = range(3, 11)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_value(v: str | Column, k: int | str | Column) -> Column:
    """h_k(v) = ((v div d) << k) | (v mod d) with d = 2^k - 1, exact for 0 <= v < 2^31. ``k`` may be a column."""
    v = _col(v).cast("long")
    d = mask(k)
    rest = v % d
    # integers throughout: v - rest is a multiple of d, and the remainder is below 2^k, so + is the same as |
    return F.call_function("div", v - rest, d) * (d + 1) + rest


def mask(w: int | str | Column) -> Column:
    """2^w - 1."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(w) if isinstance(w, int) else _col(w)) - 1


def color(v: str | Column, k: int | str | Column, w: int | str | Column) -> Column:
    """The colour of ``v`` among 2^w: the low ``w`` bits of its hash."""
    return hash_value(v, k).bitwiseAND(mask(w))


def equal_colors(a: Column, b: Column, w: int | str | Column) -> Column:
    """Whether two hashes agree in their low ``w`` bits."""
    return a.bitwiseXOR(b).bitwiseAND(mask(w)) == 0


def bit_reverse(v: str | Column) -> Column:
    """The 32 bits of ``v`` in reverse order, as a long."""
    return F.conv(F.reverse(F.lpad(F.bin(_col(v).cast("long")), 32, "0")), 2, 10).cast("long")


def bits_before(a: str | Column, b: str | Column, bits: int = 32) -> Column:
    """Whether ``a`` comes before ``b`` when their bits (32 or 64) are read in reverse order: the lowest bit that differs decides, zero first."""
    if bits not in (32, 64):
        raise ValueError(f"32 or 64 bits: {bits}")
    low = lambda c: _col(c).cast("long") if bits == 64 else _col(c).cast("long").bitwiseAND(0xFFFFFFFF)
    differ = low(a).bitwiseXOR(low(b))
    least = -(2**63)  # has no negative
    return F.when(differ == least, low(b) < 0).otherwise(low(b).bitwiseAND(differ.bitwiseAND(F.when(differ != least, -differ))) != 0)


def round_up(n: str | Column, multiple: int) -> Column:
    """``n`` rounded up to a multiple; a multiple of 0 leaves it."""
    n = _col(n).cast("long")
    return n if multiple == 0 else n + F.pmod(-n, F.lit(multiple).cast("long"))


def absolute_difference(a: str | Column, b: str | Column) -> Column:
    return F.abs(_col(a) - _col(b))


def relative_difference(a: str | Column, ref: str | Column) -> Column:
    """|a - ref| / |ref|; null where ref is zero or one of both is infinite or no number."""
    a, ref = _col(a), _col(ref)
    whole = ~(F.isnan(a) | F.isnan(ref) | is_infinite(a) | is_infinite(ref))
    return F.when(whole & (ref != 0), F.abs(a - ref) / F.abs(ref))


def is_infinite(a: str | Column) -> Column:
    return F.abs(_col(a)) == float("inf")


#: Bytes of a tile from its rows, stored entries and the graph's greatest degree, for 16 hashes, 8 widths
#: and 4-byte integers (fixed values of the reports).
HASHES, WIDTHS, INT, GROUPS = 16, 8, 4, 2

Cost = Callable[[Column, Column, Column], Column]


def _counters(rows: Column) -> Column:
    return round_up(rows, GROUPS) * (HASHES * WIDTHS)


TILE_COSTS: dict[str, Cost] = {
    "d1": lambda rows, cols, deg: (cols + rows + 1) * INT,
    "d2": lambda rows, cols, deg: (2 * (cols + rows) + 1) * INT,
    "d2_sortnet": lambda rows, cols, deg: (cols + rows + 1 + (round_up(deg, 32) + 1) * rows) * INT,
    "d1_warp": lambda rows, cols, deg: (cols + rows + 1) * INT + _counters(rows),
    "d2_warp": lambda rows, cols, deg: (cols + rows + 1 + (round_up(deg, 32) + 1) * HASHES * rows) * INT + _counters(rows),
    "d2_warp_small": lambda rows, cols, deg: (cols + rows + 1 + (cols + rows) * HASHES) * INT + _counters(rows),
}
