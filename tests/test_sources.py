import pytest

from huegraph.sources.graphs import Catalog, grid, parse_cuboid
from huegraph.sources.matrix_market import read_header, read_matrix_market, write_matrix_market


def put(tmp_path, text, name="m.mtx"):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_general_and_comments(spark, tmp_path):
    path = put(tmp_path, "%%MatrixMarket matrix coordinate real general\n% note\n" + "% more\n" * 200 + "\n3 4 3\n1 1 2.5\n 2   4 -1e3 \n3 1 3\n")
    edges, nodes = read_matrix_market(spark, path)
    assert rows(edges) == [(0, 0, 2.5), (1, 3, -1000.0), (2, 0, 3.0)] and nodes.count() == 3


def test_symmetric_is_mirrored_and_repeats_stay(spark, tmp_path):
    path = put(tmp_path, "%%MatrixMarket matrix coordinate real symmetric\n3 3 4\n1 1 1\n2 1 5\n2 1 5\n9 1 7\n")
    assert rows(read_matrix_market(spark, path)[0]) == [(0, 0, 1.0), (0, 1, 5.0), (0, 1, 5.0), (1, 0, 5.0), (1, 0, 5.0)]
    bare = put(tmp_path, "2 2 1\n2 1 4\n", "bare.mtx")
    assert rows(read_matrix_market(spark, bare)[0]) == [(0, 1, 4.0), (1, 0, 4.0)]


def test_skew_pattern_and_float(spark, tmp_path):
    skew = put(tmp_path, "%%MatrixMarket matrix coordinate real skew-symmetric\n2 2 1\n2 1 4\n")
    assert rows(read_matrix_market(spark, skew)[0]) == [(0, 1, -4.0), (1, 0, 4.0)]
    pattern = put(tmp_path, "%%MatrixMarket matrix coordinate pattern general\n2 2 2\n2 1\n1 2\n", "p.mtx")
    edges = read_matrix_market(spark, pattern, "float")[0]
    assert rows(edges) == [(0, 1, 1.0), (1, 0, 1.0)] and dict(edges.dtypes)["val"] == "float"


def test_an_entry_may_look_like_the_size_line(spark, tmp_path):
    path = put(tmp_path, "%%MatrixMarket matrix coordinate real general\n2 2 2\n2 2 2\n1 1 1\n")
    assert rows(read_matrix_market(spark, path)[0]) == [(0, 0, 1.0), (1, 1, 2.0)]


@pytest.mark.parametrize("text", ["%%MatrixMarket matrix coordinate real general\n0 2 1\n", "% only\n", "x y z\n"])
def test_bad_sizes_raise(spark, tmp_path, text):
    with pytest.raises(ValueError):
        read_header(spark, put(tmp_path, text))


def test_bad_names_raise(spark, tmp_path):
    with pytest.raises(ValueError):
        read_header(spark, put(tmp_path, "1 1 1\n", "m.txt"))
    with pytest.raises(ValueError):
        read_header(spark, ".mtx")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_header(spark, str(tmp_path / "none.mtx"))


def test_round_trip(spark, tmp_path):
    edges = spark.createDataFrame([(0, 1, 0.1), (2, 0, -3.5), (2, 2, 1e-300)], "src long, dst long, val double")
    write_matrix_market(edges, str(tmp_path / "out.mtx"), 3)
    head = read_header(spark, str(tmp_path / "out.mtx"))
    assert (head.rows, head.cols, head.entries, head.symmetry) == (3, 3, 3, "general")
    assert rows(read_matrix_market(spark, str(tmp_path / "out.mtx"))[0]) == rows(edges)


def test_parts_are_read_by_name_whatever_their_sizes(spark, tmp_path):
    folder = tmp_path / "parts.mtx"
    folder.mkdir()
    entries = [(i, j) for i in range(60) for j in range(60)]
    cuts = [0, 1, 40, 700, 3600]
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        head = "%%MatrixMarket matrix coordinate real general\n60 60 3600\n" if k == 0 else ""
        (folder / f"part-{k:05}").write_text(head + "".join(f"{i + 1} {j + 1} {i + j}\n" for i, j in entries[lo:hi]))
    (folder / "_SUCCESS").write_text("")
    assert read_header(spark, str(folder)).entries == 3600
    assert rows(read_matrix_market(spark, str(folder))[0]) == [(i, j, float(i + j)) for i, j in entries]


def test_round_trip_over_many_files(spark, tmp_path):
    edges = spark.range(5000).selectExpr("id % 71 as src", "id div 71 as dst", "cast(id as double) as val")
    write_matrix_market(edges, str(tmp_path / "many.mtx"), 71, 71, per_file=600)
    assert len(list((tmp_path / "many.mtx").glob("part-*"))) > 4
    assert rows(read_matrix_market(spark, str(tmp_path / "many.mtx"))[0]) == rows(edges)


def test_catalog_loads_once(spark, tmp_path):
    put(tmp_path, "1 1 1\n1 1 1\n", "af_shell3.mtx")
    catalog = Catalog(spark, str(tmp_path))
    first = catalog.load("af_shell3")[0]
    assert catalog.load("af_shell3")[0] is first and rows(first) == [(0, 0, 1.0)]
    catalog.clear()


def test_grid(spark):
    edges, nodes = grid(spark, 2, 3, 4)
    got = rows(edges)
    index = {(x, y, z): x + 2 * y + 6 * z for x in range(2) for y in range(3) for z in range(4)}
    want = [(i, index[x + a, y + b, z + c], 6.0 if not (a or b or c) else -1.0) for (x, y, z), i in index.items() for a, b, c in ((0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) if (x + a, y + b, z + c) in index]
    assert got == sorted(want) and nodes.count() == 24
    assert parse_cuboid("2x3x4") == (2, 3, 4)
    with pytest.raises(ValueError):
        parse_cuboid("2x0x4")
