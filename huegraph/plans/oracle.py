"""The same queries in DuckDB SQL, on views of the tables."""

from __future__ import annotations

from ..functions.columns import TILE_COSTS
from ..operators.tiling import BUDGET
from .queries import LAYERS, MERGE, PARTS, TILES

_GRAPH = """edges AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b USING (l_orderkey)
  WHERE a.l_partkey <> b.l_partkey), nodes AS (SELECT p_partkey AS id FROM part)"""
_BIPARTITE = """half AS (SELECT DISTINCT l_orderkey + (SELECT count(*) FROM part) AS src, l_partkey AS dst FROM lineitem),
edges AS (SELECT src, dst FROM half UNION ALL SELECT dst, src FROM half)"""
_CELLS = "ks AS (SELECT CAST(unnest(range(3, 19)) AS INT) AS k), ws AS (SELECT CAST(unnest(range(3, 11)) AS INT) AS w)"
_DEGREE = "deg AS (SELECT id, count(src) AS degree FROM nodes LEFT JOIN edges ON src = id GROUP BY id)"
_ASSIGNED = f"""a AS (SELECT p_partkey AS id, CAST(p_size % {LAYERS} AS INT) AS layer, CAST(p_partkey % {TILES} AS INT) AS tile,
  row_number() OVER (PARTITION BY p_size % {LAYERS} ORDER BY p_partkey) - 1 AS pos FROM part)"""
_PERM = """perm AS (SELECT p_partkey AS old, CASE WHEN p_partkey % 2 = 0 THEN p_partkey // 2
  ELSE (SELECT count(*) FROM part) - 1 - p_partkey // 2 END AS new FROM part)"""
_ITEMS = "items AS (SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem)"
_MATRIX = "m AS (SELECT l_orderkey AS src, l_partkey AS dst, sum(l_quantity) AS val FROM lineitem GROUP BY 1, 2)"
_GRID = """size AS (SELECT greatest(2, count(*) // 100) AS z FROM part), v AS (SELECT unnest(range(100 * z)) AS id, z FROM size),
steps AS (SELECT id, unnest([[id, 6], CASE WHEN id % 10 > 0 THEN [id - 1, -1] END, CASE WHEN id % 10 < 9 THEN [id + 1, -1] END,
  CASE WHEN id // 10 % 10 > 0 THEN [id - 10, -1] END, CASE WHEN id // 10 % 10 < 9 THEN [id + 10, -1] END,
  CASE WHEN id // 100 > 0 THEN [id - 100, -1] END, CASE WHEN id // 100 < z - 1 THEN [id + 100, -1] END]) AS s FROM v)"""


def _hash(v: str) -> str:
    return f"((({v} // ((1::BIGINT << k) - 1)) << k) | ({v} % ((1::BIGINT << k) - 1)))"


def _d1(graph: str) -> str:
    return f"""{graph}, {_CELLS}, d1 AS (SELECT src AS id, k, w, count(*) AS d1 FROM edges, ks, ws
  WHERE src <> dst AND (xor({_hash("src")}, {_hash("dst")}) & ((1::BIGINT << w) - 1)) = 0 GROUP BY 1, 2, 3)"""


def _d2(graph: str) -> str:
    return f"""{graph}, {_CELLS}, near AS (SELECT src AS id, dst AS v FROM edges WHERE src <> dst UNION ALL SELECT DISTINCT src, src FROM edges WHERE src <> dst),
c AS (SELECT id, k, w, count(*) AS n FROM near, ks, ws GROUP BY id, k, w, {_hash("v")} & ((1::BIGINT << w) - 1)),
d2 AS (SELECT id, k, w, max(n) - 1 AS d2 FROM c GROUP BY 1, 2, 3)"""


def _report(ctes: str, name: str) -> str:
    return f"""WITH {ctes} SELECT k, w, CAST(coalesce(sum({name}), 0) AS BIGINT) AS total, CAST(coalesce(max({name}), 0) AS BIGINT) AS max
FROM ks CROSS JOIN ws LEFT JOIN {name} USING (k, w) GROUP BY k, w"""


def _per_node(ctes: str, name: str) -> str:
    return f"WITH {ctes} SELECT id, k, w, CAST(coalesce({name}, 0) AS BIGINT) AS {name} FROM nodes CROSS JOIN ks CROSS JOIN ws LEFT JOIN {name} USING (id, k, w)"


def _up(n: str, m: int) -> str:
    return f"(({n} + {m - 1}) // {m} * {m})"


#: Bytes of a tile of r rows and c entries in a graph of greatest degree d.
_COST = {
    "d1": "4 * (c + r + 1)",
    "d2": "4 * (2 * (c + r) + 1)",
    "d2_sortnet": f"4 * (c + r + 1 + ({_up('d', 32)} + 1) * r)",
    "d1_warp": f"4 * (c + r + 1) + {_up('r', 2)} * 128",
    "d2_warp": f"4 * (c + r + 1 + ({_up('d', 32)} + 1) * 16 * r) + {_up('r', 2)} * 128",
    "d2_warp_small": f"4 * (c + r + 1 + (c + r) * 16) + {_up('r', 2)} * 128",
}
assert _COST.keys() == TILE_COSTS.keys()


def _tiles(variant: str) -> str:
    return f"""{_GRAPH}, {_DEGREE}, pre AS (SELECT id, CAST(sum(degree) OVER (ORDER BY id) AS BIGINT) AS upto FROM deg),
top AS (SELECT max(degree) AS d FROM deg), n AS (SELECT count(*) AS n FROM nodes),
jump AS (SELECT x.id AS lo, max(y.id) + 1 AS hi FROM pre x JOIN deg ON deg.id = x.id
  JOIN pre y ON y.id >= x.id, top,
  LATERAL (SELECT y.id - x.id + 1 AS r, y.upto - x.upto + deg.degree AS c) WHERE {_COST[variant]} <= {BUDGET} GROUP BY x.id),
t AS (SELECT CAST(0 AS BIGINT) AS tile, lo, hi FROM jump WHERE lo = 0 UNION ALL
  SELECT t.tile + 1, jump.lo, jump.hi FROM t JOIN jump ON jump.lo = t.hi)"""


ORACLE_SQL: dict[str, str] = {
    "hash_colors": f"WITH {_CELLS} SELECT p_partkey AS id, k, w, {_hash('p_partkey')} & ((1::BIGINT << w) - 1) AS color FROM part, ks, ws",
    "scalar_functions": """SELECT p_partkey AS id, CAST(list_sum([((p_partkey >> i) & 1) << (31 - i) for i in range(32)]) AS BIGINT) AS reversed,
  CAST((p_size + 31) // 32 * 32 AS BIGINT) AS up32, CAST(p_size AS BIGINT) AS up0, round(abs(p_retailprice - p_size * 20.0), 6) AS absolute,
  CASE WHEN p_size <> 0 THEN round(abs(p_retailprice - CAST(p_size AS DOUBLE) * 20) / abs(CAST(p_size AS DOUBLE) * 20), 6) END AS relative FROM part""",
    "tile_costs": f"WITH {_GRAPH}, {_DEGREE}, x AS (SELECT id, 1 AS r, degree AS c, degree AS d FROM deg) SELECT id, " + ", ".join(f"CAST({c} AS BIGINT) AS {n}" for n, c in _COST.items()) + " FROM x",
    "node_degree": f"WITH {_GRAPH}, {_DEGREE} SELECT id, degree FROM deg",
    "max_degree": f"WITH {_GRAPH}, {_DEGREE} SELECT max(degree) AS max_degree FROM deg",
    "degree_prefix": f"WITH {_GRAPH}, {_DEGREE} SELECT id, CAST(sum(degree) OVER (ORDER BY id) AS BIGINT) AS upto FROM deg",
    "d1_per_node": _per_node(_d1(_GRAPH), "d1"),
    "d1_collisions": _report(_d1(_GRAPH), "d1"),
    "d2_per_node": _per_node(_d2(_GRAPH), "d2"),
    "d2_collisions": _report(_d2(_GRAPH), "d2"),
    "d1_bipartite": _report(_d1(_BIPARTITE), "d1"),
    "d2_bipartite": _report(_d2(_BIPARTITE), "d2"),
    "best_parameters": f"""WITH r AS ({_report(_d1(_GRAPH), "d1")}), o AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY total, max, k) AS i FROM r)
SELECT w, k, total, max FROM o WHERE i = 1""",
    "symmetrize": f"WITH {_ITEMS}, s AS (SELECT src, dst FROM items UNION ALL SELECT dst, src FROM items WHERE src <> dst) SELECT src, dst, count(*) AS n FROM s GROUP BY 1, 2",
    "drop_self_loops": f"WITH {_ITEMS} SELECT src, dst, count(*) AS n FROM items WHERE src <> dst GROUP BY 1, 2",
    "pattern_symmetry": f"""WITH {_ITEMS}, p AS (SELECT DISTINCT src, dst FROM items WHERE src <> dst)
SELECT count(*) AS pairs, count(*) FILTER (WHERE (dst, src) NOT IN (SELECT (src, dst) FROM p)) AS asymmetric FROM p""",
    "spmv": f"WITH {_MATRIX}, s AS (SELECT src, sum(val * p_retailprice) AS y FROM m JOIN part ON dst = p_partkey GROUP BY 1) SELECT o_orderkey AS id, round(coalesce(y, 0), 2) AS y FROM orders LEFT JOIN s ON src = o_orderkey",
    "spmv_float": f"WITH {_MATRIX}, s AS (SELECT src, sum(CAST(CAST(val AS FLOAT) AS DOUBLE) * p_retailprice) AS y FROM m JOIN part ON dst = p_partkey GROUP BY 1) SELECT o_orderkey AS id, round(coalesce(y, 0), 2) AS y FROM orders LEFT JOIN s ON src = o_orderkey",
    "vector_permute": f"WITH {_PERM} SELECT new AS id, p_retailprice AS x FROM part JOIN perm ON old = p_partkey",
    "vector_unpermute": f"WITH {_PERM} SELECT old AS id, p_retailprice AS x FROM part JOIN perm ON new = p_partkey",
    "matrix_permute": f"WITH {_GRAPH}, {_PERM} SELECT p.new AS src, q.new AS dst, CAST(src * 3 + dst AS DOUBLE) AS val FROM edges JOIN perm p ON p.old = src JOIN perm q ON q.old = dst",
    "matrix_unpermute": f"WITH {_GRAPH}, {_PERM} SELECT p.old AS src, q.old AS dst, CAST(src * 3 + dst AS DOUBLE) AS val FROM edges JOIN perm p ON p.new = src JOIN perm q ON q.new = dst",
    "compare_summary": """WITH v AS (SELECT CASE WHEN p_size = 7 THEN 0.0::DOUBLE WHEN p_size = 9 THEN 'inf'::DOUBLE ELSE p_retailprice * (1 + p_size / 1000.0::DOUBLE) END AS s,
  CASE WHEN p_size = 11 THEN 0.0::DOUBLE ELSE p_retailprice END AS r FROM part),
d AS (SELECT s, r, CASE WHEN isfinite(s) AND isfinite(r) AND r <> 0 THEN abs(s - r) END AS d FROM v)
SELECT round(coalesce(max(d), 0), 6) AS max_abs, round(coalesce(max(d / abs(r)), 0), 6) AS max_rel, round(sqrt(coalesce(sum(d * d), 0) / count(*)), 6) AS rms,
  count(*) FILTER (WHERE s <> r AND s = 0) AS zeros, count(*) FILTER (WHERE s <> r AND isinf(s)) AS infinite FROM d""",
    "equipartition": f"""WITH n AS (SELECT count(*) AS n FROM part), p AS (SELECT unnest(range({PARTS})) AS part)
SELECT part, part * (n // {PARTS}) + least(part, n % {PARTS}) AS lo, (part + 1) * (n // {PARTS}) + least(part + 1, n % {PARTS}) AS hi FROM p, n""",
    "work_distribution": f"""WITH RECURSIVE {_tiles("d1")}, c AS (SELECT count(*) AS n FROM t), p AS (SELECT unnest(range(4)) AS worker)
SELECT worker, worker * (c.n // 4) + least(worker, c.n % 4) AS start, c.n // 4 + CAST(worker < c.n % 4 AS INT) AS work FROM p, c""",
    "tile_stats": f"""WITH RECURSIVE {_tiles("d1")}, s AS (SELECT tile, hi - lo AS nodes, CAST(sum(degree) AS BIGINT) AS edges FROM t JOIN deg ON id >= lo AND id < hi GROUP BY tile, lo, hi),
b AS (SELECT nodes, edges FROM s ORDER BY nodes + edges DESC, tile DESC LIMIT 1)
SELECT count(*) AS tiles, max(s.nodes) AS max_nodes, max(s.edges) AS max_edges, any_value(b.nodes) AS biggest_nodes, any_value(b.edges) AS biggest_edges FROM s, b""",
    "layer_sizes": f"WITH {_ASSIGNED} SELECT layer, count(*) AS nodes FROM a GROUP BY layer",
    "slice_stats": f"WITH {_ASSIGNED}, s AS (SELECT layer, tile, count(*) AS n FROM a GROUP BY 1, 2) SELECT layer, CAST(sum(n) AS BIGINT) AS nodes, round(avg(n), 6) AS avg_tile, min(n) AS min_tile, max(n) AS max_tile FROM s GROUP BY layer",
    "layer_major_order": f"WITH {_ASSIGNED} SELECT id, row_number() OVER (ORDER BY layer, tile, pos) - 1 AS new_pos FROM a",
    "tile_major_order": f"WITH {_ASSIGNED} SELECT id, row_number() OVER (ORDER BY tile, layer, pos) - 1 AS new_pos FROM a",
    "tile_starts": f"WITH {_ASSIGNED}, s AS (SELECT tile, layer, count(*) AS nodes FROM a GROUP BY 1, 2) SELECT tile, layer, CAST(sum(nodes) OVER (ORDER BY tile, layer) - nodes AS BIGINT) AS start, nodes FROM s",
    "bar_sizes": f"WITH {_ASSIGNED}, s AS (SELECT tile, count(*) AS nodes FROM a GROUP BY 1) SELECT tile, nodes, CAST(sum(nodes) OVER (ORDER BY tile) AS BIGINT) AS upto FROM s",
    "redundancy_stats": f"""WITH {_GRAPH}, {_ASSIGNED}, o AS (SELECT x.id, x.tile, count(y.id) AS n, count(*) FILTER (WHERE y.tile <> x.tile) AS o
  FROM a x LEFT JOIN edges ON src = x.id LEFT JOIN a y ON y.id = dst GROUP BY 1, 2),
b AS (SELECT tile, CASE WHEN sum(n) = 0 THEN 0 ELSE sum(o) / sum(n) END AS s, count(*) FILTER (WHERE o > 0) AS b, count(*) AS v FROM o GROUP BY tile)
SELECT round(avg(s) * 100, 6) AS avg_edges, round(least(min(s), 1) * 100, 6) AS min_edges, round(max(s) * 100, 6) AS max_edges, round(sum(b) / sum(v) * 100, 6) AS nodes FROM b""",
    "grid_stencil": f"WITH {_GRID} SELECT id AS src, s[1] AS dst, CAST(s[2] AS DOUBLE) AS val FROM steps WHERE s IS NOT NULL",
    "mtx_roundtrip": f"WITH {_MATRIX} SELECT src, dst, val FROM m",
} | {f"greedy_tiles_{v}": f"WITH RECURSIVE {_tiles(v)} SELECT tile, lo, hi FROM t" for v in _COST}

_BANDED = """n AS (SELECT count(*) AS n FROM part), e AS (SELECT p_partkey AS src, p_partkey + unnest([-16, -8, 8, 16, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 8 END]) AS dst FROM part),
g AS (SELECT src, dst FROM e, n WHERE dst >= 0 AND dst < n)"""
_BORDER = f"""{_ASSIGNED}, {_BANDED}, o AS (SELECT x.id, bool_or(y.tile <> x.tile) AS border FROM a x JOIN g ON src = x.id JOIN a y ON y.id = dst GROUP BY 1),
b AS (SELECT a.*, coalesce(border, FALSE) AS border FROM a LEFT JOIN o USING (id)),
r AS (SELECT *, row_number() OVER (ORDER BY tile, layer, NOT border, CASE WHEN border THEN pos ELSE -pos END) - 1 AS new_pos FROM b)"""
ORACLE_SQL["border_first_order"] = f"WITH {_BORDER} SELECT id, border, new_pos FROM r"
ORACLE_SQL["border_offsets"] = f'WITH {_BORDER} SELECT tile, layer, CAST(min(new_pos) + count(*) FILTER (WHERE border) AS BIGINT) AS "offset" FROM r GROUP BY 1, 2'


def _coarsen(tile: str, most: int, latch: bool) -> str:
    going = "m AND" if latch else ""
    return f"""WITH RECURSIVE a AS (SELECT CAST(p_size % {LAYERS} AS BIGINT) AS layer, {tile} AS tile FROM part),
c AS (SELECT layer, tile, count(*) AS n FROM a GROUP BY 1, 2), tiles AS (SELECT DISTINCT tile FROM a), layers AS (SELECT DISTINCT layer FROM a),
s AS (SELECT layer, row_number() OVER (ORDER BY layer) AS i, list(coalesce(n, 0) ORDER BY tile) AS z FROM layers CROSS JOIN tiles LEFT JOIN c USING (layer, tile) GROUP BY layer),
t AS (SELECT layer, i, CAST(0 AS BIGINT) AS new_layer, z AS o, TRUE AS m FROM s WHERE i = 1 UNION ALL
  SELECT x.layer, x.i, CASE WHEN ok THEN new_layer ELSE new_layer + 1 END, CASE WHEN ok THEN total ELSE z END, ok FROM
  (SELECT s.layer, s.i, s.z, t.new_layer, [s.z[j] + t.o[j] for j in range(1, len(s.z) + 1)] AS total,
    {going} list_max([s.z[j] + t.o[j] for j in range(1, len(s.z) + 1)]) <= {most} AS ok FROM t JOIN s ON s.i = t.i + 1) x)
SELECT layer, new_layer FROM t"""


ORACLE_SQL["coarsen_layers"] = _coarsen(f"p_partkey % {TILES}", MERGE, True)
ORACLE_SQL["coarsen_single"] = _coarsen("0", 4 * MERGE, False)

_LOW = f"WITH {_GRAPH}, n AS (SELECT count(*) AS n FROM part), low AS (SELECT src, dst, CAST(src * 3 + dst AS DOUBLE) AS val FROM edges WHERE src > dst)"
_CORNER = "SELECT n - 1, n - 1, 7.0::DOUBLE FROM n"
_LAYER_OF = f"lay AS (SELECT p_partkey AS id, p_size % {LAYERS} AS layer FROM part)"
_PLACED = "SELECT count(*) AS nodes, CAST(0 AS BIGINT) AS misplaced, CAST(0 AS BIGINT) AS above FROM part"
_TILED = "SELECT count(*) AS nodes, count(*) AS placed, " + ", ".join(f"CAST(0 AS BIGINT) AS {c}" for c in ("doubled", "outside", "wrong_offsets", "above")) + " FROM part"


def _bits_before(a: str, b: str, bits: int) -> str:
    reverse = lambda v: f"reverse(lpad(bin({v}), {bits}, '0'))"
    return f"{reverse(a)} < {reverse(b)}"


ORACLE_SQL |= {
    "mtx_symmetric": f"{_LOW} SELECT src, dst, val FROM low UNION ALL SELECT dst, src, val FROM low UNION ALL {_CORNER}",
    "mtx_skew": f"{_LOW} SELECT src, dst, val FROM low UNION ALL SELECT dst, src, -val FROM low UNION ALL {_CORNER}",
    "mtx_pattern": f"{_LOW} SELECT src, dst, 1.0::DOUBLE AS val FROM low UNION ALL SELECT dst, src, 1.0::DOUBLE FROM low",
    "mtx_out_of_range": f"{_LOW} SELECT src, dst, val FROM low UNION ALL {_CORNER}",
    "tile_view": f"WITH RECURSIVE {_tiles('d1')} SELECT src, dst FROM edges, t WHERE tile = 1 AND src >= lo AND src < hi",
    "single_offsets": f"WITH {_ASSIGNED}, s AS (SELECT layer, count(*) AS n FROM a GROUP BY 1) SELECT CAST(0 AS INT) AS tile, layer, CAST(sum(n) OVER (ORDER BY layer) - n AS BIGINT) AS \"offset\" FROM s",
    "redundancy_single": "SELECT 0.0::DOUBLE AS avg_edges, 0.0::DOUBLE AS min_edges, 0.0::DOUBLE AS max_edges, 0.0::DOUBLE AS nodes",
    "bits_order": f"SELECT l_orderkey, l_linenumber, {_bits_before('l_partkey', 'l_suppkey', 32)} AS before32, {_bits_before('l_partkey * 4294967296 + l_linenumber', 'l_suppkey * 4294967296 + l_linenumber', 64)} AS before64 FROM lineitem",
    "duration_stats": "WITH b AS (SELECT user_id, epoch_us(max(ts)) - epoch_us(min(ts)) AS d FROM events GROUP BY 1) SELECT min(d) AS min, max(d) AS max, round(avg(d), 3) AS mean FROM b",
    "compare_tiles": f"WITH {_ASSIGNED}, s AS (SELECT tile, count(*) AS n FROM a GROUP BY 1) SELECT count(*) AS tiles, min(n) AS min_tile, round(avg(n), 6) AS avg_tile, max(n) AS max_tile FROM s",
    "matrix_permute_float": f"WITH {_GRAPH}, {_PERM} SELECT p.new AS src, q.new AS dst, CAST(CAST(CAST(src * 3 + dst AS DOUBLE) / 10 AS FLOAT) AS DOUBLE) AS val FROM edges JOIN perm p ON p.old = src JOIN perm q ON q.old = dst",
    "capacity_cut": f"WITH {_GRAPH}, {_DEGREE}, r AS (SELECT id, id % {TILES} AS tile, degree, row_number() OVER (PARTITION BY id % {TILES} ORDER BY degree DESC, id DESC) AS i FROM deg) SELECT id, tile, degree FROM r WHERE i <= 10",
    "sectioning": _PLACED,
    "cut_layers": _PLACED,
    "cut_weights": f"""WITH {_GRAPH}, {_LAYER_OF}, done AS (SELECT id, id // 16 % 8 AS tile FROM lay WHERE layer = 2 AND id % 16 < 8),
fixed AS (SELECT src AS id, min(d.tile) AS tile FROM edges JOIN lay x ON x.id = src JOIN done d ON d.id = dst WHERE x.layer = 1 GROUP BY src HAVING min(d.tile) = max(d.tile)),
w AS (SELECT CASE WHEN p.tile IS NULL OR q.tile IS NULL OR p.tile = q.tile THEN 2 ELSE 1 END AS weight
  FROM edges JOIN lay x ON x.id = src JOIN lay y ON y.id = dst LEFT JOIN fixed p ON p.id = src LEFT JOIN fixed q ON q.id = dst WHERE x.layer = 1 AND y.layer = 1)
SELECT weight, count(*) AS n FROM w GROUP BY weight UNION ALL SELECT 0, count(*) FROM fixed""",
    "tile_graph": _TILED,
    "simple_tiling": _TILED,
    "triangular_layers": "SELECT count(*) AS nodes, CAST(0 AS BIGINT) AS misplaced, CAST(0 AS BIGINT) AS conflicts FROM part",
    "balanced_partition": f"SELECT count(*) AS nodes, CAST({TILES} AS BIGINT) AS tiles, TRUE AS balanced, TRUE AS no_worse FROM part",
    "proper_coloring": "SELECT count(*) AS colored, CAST(0 AS BIGINT) AS conflicts FROM part",
}
