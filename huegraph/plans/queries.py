"""The registered queries. Every one runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import KS, TILE_COSTS, WS, absolute_difference, bit_reverse, bits_before, color, relative_difference, round_up
from ..operators import collisions, linalg, sectioning, tiling
from ..runtime import materialize, scratch
from ..sources.graphs import grid, order_part_graph, order_part_matrix, part_graph, part_nodes
from ..sources.matrix_market import read_matrix_market, write_matrix_market

Query = Callable[[SparkSession, str], DataFrame]
PARTS, TILES, LAYERS, MERGE = 7, 8, 5, 200


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def _order_part(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = _part(spark, sf_dir).count() + spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    return order_part_graph(spark, sf_dir), spark.range(n)


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("x"))


def _reversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A permutation of the parts: even ids in front, odd ones behind in falling order."""
    n = _part(spark, sf_dir).count()
    new = F.when(F.col("p_partkey") % 2 == 0, F.expr("p_partkey div 2")).otherwise(n - 1 - F.expr("p_partkey div 2"))
    return _part(spark, sf_dir).select(F.col("p_partkey").alias("old"), new.cast("long").alias("new"))


def assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in layers by size and tiles by id."""
    layer, tile = (F.col("p_size") % LAYERS).cast("int"), (F.col("p_partkey") % TILES).cast("int")
    rows = _part(spark, sf_dir).select(F.col("p_partkey").alias("id"), layer.alias("layer"), tile.alias("tile"))
    return rows.withColumn("pos", (F.row_number().over(Window.partitionBy("layer").orderBy("id")) - 1).cast("long"))


def _grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """A cuboid with about a vertex for each part."""
    z = max(2, _part(spark, sf_dir).count() // 100)
    edges, nodes = grid(spark, 10, 10, z)
    return edges, nodes, 100 * z


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_graph(spark, sf_dir).withColumn("val", (F.col("src") * 3 + F.col("dst")).cast("double"))


def hash_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_nodes(spark, sf_dir).select("id", F.explode(F.array(*map(F.lit, KS))).alias("k")).select("id", "k", F.explode(F.array(*map(F.lit, WS))).alias("w"))
    return rows.select("id", "k", "w", color("id", F.col("k"), F.col("w")).alias("color"))


def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bit reversal, rounding up, and differences of two columns."""
    a, b = F.col("p_retailprice"), F.col("p_size").cast("double") * 20
    return _part(spark, sf_dir).select(F.col("p_partkey").alias("id"), bit_reverse("p_partkey").alias("reversed"), round_up("p_size", 32).alias("up32"), round_up("p_size", 0).alias("up0"), F.round(absolute_difference(a, b), 6).alias("absolute"), F.round(relative_difference(a, b), 6).alias("relative"))


def tile_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of a tile of one row for every vertex, by every variant."""
    by_row = linalg.degrees(part_graph(spark, sf_dir), part_nodes(spark, sf_dir))
    one = F.lit(1).cast("long")
    return by_row.select("id", *(cost(one, F.col("degree"), F.col("degree")).cast("long").alias(name) for name, cost in TILE_COSTS.items()))


def node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.degrees(part_graph(spark, sf_dir), part_nodes(spark, sf_dir))


def max_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_degree(spark, sf_dir).agg(F.max("degree").alias("max_degree"))


def degree_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.prefix_sum(node_degree(spark, sf_dir), "degree", "upto").select("id", "upto")


def d1_per_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.d1_per_node(part_graph(spark, sf_dir), part_nodes(spark, sf_dir))


def d1_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.d1_collisions(part_graph(spark, sf_dir))


def d2_per_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.d2_per_node(part_graph(spark, sf_dir), part_nodes(spark, sf_dir))


def d2_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.d2_collisions(part_graph(spark, sf_dir))


def d1_bipartite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.d1_collisions(_order_part(spark, sf_dir)[0])


def d2_bipartite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.d2_collisions(_order_part(spark, sf_dir)[0])


def best_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.best_parameters(d1_collisions(spark, sf_dir))


def symmetrize(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return linalg.symmetrize(items).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def drop_self_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return items.filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def pattern_symmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return linalg.pattern_symmetry(items)


def spmv(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    return linalg.spmv(order_part_matrix(spark, sf_dir), _prices(spark, sf_dir), orders).select("id", F.round("y", 2).alias("y"))


def spmv_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product with values read in single precision."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    matrix = linalg.with_precision(order_part_matrix(spark, sf_dir), "float")
    return linalg.spmv(matrix, _prices(spark, sf_dir), orders).select("id", F.round("y", 2).alias("y"))


def vector_permute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.permute_vector(_prices(spark, sf_dir), _reversal(spark, sf_dir))


def vector_unpermute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.unpermute_vector(_prices(spark, sf_dir), _reversal(spark, sf_dir))


def matrix_permute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.permute_matrix(_weighted(spark, sf_dir), _reversal(spark, sf_dir))


def matrix_unpermute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.unpermute_matrix(_weighted(spark, sf_dir), _reversal(spark, sf_dir))


def compare_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices against prices with a relative error by size; some zeros and infinite values."""
    p = _part(spark, sf_dir)
    wrong = F.when(F.col("p_size") == 7, 0.0).when(F.col("p_size") == 9, float("inf")).otherwise(F.col("p_retailprice") * (1 + F.col("p_size") / 1000.0))
    ref = F.when(F.col("p_size") == 11, 0.0).otherwise(F.col("p_retailprice"))
    got = linalg.compare(p.select(F.col("p_partkey").alias("id"), wrong.alias("x")), p.select(F.col("p_partkey").alias("id"), ref.alias("x")))
    return got.select(*(F.round(c, 6).alias(c) for c in ("max_abs", "max_rel", "rms")), "zeros", "infinite")


def equipartition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.equal_parts(spark, _part(spark, sf_dir).count(), PARTS)


def work_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles of the part graph over workers: the same rule."""
    return tiling.equal_parts(spark, _greedy("d1")(spark, sf_dir).count(), 4).select(F.col("part").alias("worker"), F.col("lo").alias("start"), (F.col("hi") - F.col("lo")).alias("work"))


def _greedy(variant: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tiling.greedy_tiles(part_graph(spark, sf_dir), part_nodes(spark, sf_dir), variant)

    return query


def tile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, nodes = part_graph(spark, sf_dir), part_nodes(spark, sf_dir)
    by_row = materialize(linalg.degrees(edges, nodes), "degrees")
    return tiling.tile_stats(tiling.greedy_tiles(edges, nodes, "d1", by_row=by_row), edges, nodes, by_row)


def tile_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of the second tile of the part graph."""
    edges = part_graph(spark, sf_dir)
    tile = _greedy("d1")(spark, sf_dir).filter("tile = 1").first()
    return tiling.tile_view(edges, *(tile[1:] if tile else (0, 0)))


def layer_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.layer_sizes(assignment(spark, sf_dir))


def slice_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.slice_stats(assignment(spark, sf_dir)).withColumn("avg_tile", F.round("avg_tile", 6))


def layer_major_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.layer_major(assignment(spark, sf_dir)).select("id", F.col("new_pos").cast("long").alias("new_pos"))


def tile_major_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.tile_major(assignment(spark, sf_dir)).select("id", F.col("new_pos").cast("long").alias("new_pos"))


def tile_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.tile_starts(assignment(spark, sf_dir))


def bar_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.bar_sizes(assignment(spark, sf_dir))


def _banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose ids differ by a multiple of the number of tiles up to two tiles on: some borders, some interior."""
    p = part_nodes(spark, sf_dir)
    n = p.count()
    steps = F.array(*(F.lit(d) for d in (-16, -8, 8, 16)), F.when(F.col("id") % 5 == 0, 1).otherwise(8))
    return p.select(F.col("id").alias("src"), F.explode(F.transform(steps, lambda d: F.col("id") + d)).alias("dst")).filter((F.col("dst") >= 0) & (F.col("dst") < n))


def border_first_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.border_first(_banded(spark, sf_dir), assignment(spark, sf_dir)).select("id", "border", F.col("new_pos").cast("long").alias("new_pos"))


def border_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.border_offsets(_banded(spark, sf_dir), assignment(spark, sf_dir))


def redundancy_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.redundancy(part_graph(spark, sf_dir), assignment(spark, sf_dir)).select(*(F.round(c, 6).alias(c) for c in ("avg_edges", "min_edges", "max_edges", "nodes")))


def coarsen_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.coarsen(assignment(spark, sf_dir), MERGE)


def coarsen_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.coarsen(assignment(spark, sf_dir).withColumn("tile", F.lit(0)), 4 * MERGE, end_at_first=False)


def single_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts of a layer as one tile."""
    return tiling.single_offsets(assignment(spark, sf_dir).withColumn("tile", F.lit(0)))


def redundancy_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.redundancy_single(spark)


def bits_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of items before each other when their bits are read in reverse, as 32 and as 64 bits."""
    a, b = F.col("l_partkey"), F.col("l_suppkey")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    wide = lambda c: c * 4294967296 + F.col("l_linenumber")
    return items.select("l_orderkey", "l_linenumber", bits_before(a, b).alias("before32"), bits_before(wide(a), wide(b), 64).alias("before64"))


def duration_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long the events of a user last, in microseconds: least, greatest and mean."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    blocks = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.min(at).alias("start"), F.max(at).alias("stop"))
    return linalg.durations(blocks).withColumn("mean", F.round("mean", 3))


def compare_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report of a comparison says on its tiles."""
    return tiling.share_stats(tiling.bar_sizes(assignment(spark, sf_dir))).withColumn("avg_tile", F.round("avg_tile", 6))


def matrix_permute_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenth = _weighted(spark, sf_dir).withColumn("val", F.col("val") / 10)
    return linalg.permute_matrix(tenth, _reversal(spark, sf_dir), "float").withColumn("val", F.col("val").cast("double"))


def capacity_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each tile with most neighbours, ten at most, later ids first among equals."""
    votes = linalg.degrees(part_graph(spark, sf_dir), part_nodes(spark, sf_dir)).withColumn("tile", F.col("id") % TILES).withColumn("room", F.lit(10))
    return tiling.strongest(votes, ["tile"], [F.desc("degree"), F.desc("id")], "room").select("id", "tile", "degree")


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir).select(F.col("p_partkey").alias("id"), (F.col("p_size") % LAYERS).cast("int").alias("layer"))


def _placed_check(nodes: DataFrame, layers: DataFrame, found: DataFrame, most: DataFrame) -> DataFrame:
    """One row on an assignment: vertices, those without exactly one place in their layer, and tiles above ``most`` (one row)."""
    times = found.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("layer").alias("l"), F.min("tile").alias("lo"), F.max("tile").alias("hi"))
    rows = nodes.join(layers, "id").join(times, "id", "left")
    wrong = F.count_if(~F.coalesce((F.col("n") == 1) & (F.col("l") == F.col("layer")) & (F.col("lo") >= 0) & (F.col("hi") < TILES), F.lit(False))).alias("misplaced")
    sizes = found.groupBy("layer", "tile").agg(F.count(F.lit(1)).alias("n"))
    above = sizes.join(F.broadcast(most), F.col("n") > F.col("most")).agg(F.count(F.lit(1)).alias("above"))
    return rows.agg(F.count(F.lit(1)).alias("nodes"), wrong).join(F.broadcast(above))  # one row and one row


def sectioning_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in layers by size: tiles by votes, checked. No tile is above the share of the largest layer (by a thousandth)."""
    layers = _layers(spark, sf_dir)
    found = materialize(sectioning.section_layers(part_graph(spark, sf_dir), layers, TILES), "found")
    most = layers.groupBy("layer").agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.greatest(F.ceil(F.col("n") / TILES), F.floor(F.col("n") * 1.001 / TILES))).alias("most"))
    return _placed_check(part_nodes(spark, sf_dir), layers, found, most)


def cut_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in layers by size: tiles by weighted cuts, checked. No tile is above the share of the largest layer by more than the slack."""
    layers = _layers(spark, sf_dir)
    found = materialize(sectioning.cut_layers(part_graph(spark, sf_dir), layers, TILES), "found")
    most = layers.groupBy("layer").agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.greatest(F.ceil(F.col("n") / TILES), F.floor(F.col("n") * (1 + sectioning.SLACK / 1000) / TILES))).alias("most"))
    return _placed_check(part_nodes(spark, sf_dir), layers, found, most)


def cut_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cut of a layer starts from: its vertices that have their tile from the layer behind, and its edges by weight."""
    layers = _layers(spark, sf_dir)
    links = sectioning.layer_links(part_graph(spark, sf_dir), layers)
    done = assignment(spark, sf_dir).filter("layer = 2 AND id % 16 < 8").select("id", F.expr("id div 16 % 8").alias("tile"))
    fixed = materialize(sectioning.preassigned(links, done, 1, 2), "fixed")
    weights = sectioning.edge_weights(links, fixed, 1).groupBy("weight").agg(F.count(F.lit(1)).alias("n"))
    return weights.unionByName(fixed.agg(F.lit(0).alias("weight"), F.count(F.lit(1)).alias("n")))


def _tiling_check(made: sectioning.Tiling, nodes: DataFrame) -> DataFrame:
    """One row on a whole tiling: vertices, places of the order that are missing or taken twice, vertices outside their tile's range, border
    vertices on the wrong side of the offset, tiles above the capacity."""
    tile = made.starts.join(made.offsets, ["tile", "layer"])
    at = made.order.join(made.assigned.select("id", "layer", "tile"), "id").join(tile, ["tile", "layer"])
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    out = at.agg(
        (F.count(F.lit(1)) - F.count_distinct("new_pos")).alias("doubled"),
        F.count_if((F.col("new_pos") < F.col("start")) | (F.col("new_pos") >= F.col("start") + F.col("nodes"))).alias("outside"),
        F.count_if((F.col("offset") < F.col("start")) | (F.col("offset") > F.col("start") + F.col("nodes"))).alias("wrong_offsets"),
        F.count_if(F.col("nodes") > made.most).alias("above"),
        F.count(F.lit(1)).alias("placed"),
    )
    return n.join(F.broadcast(out))  # one row and one row


def tile_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole tiling of the part graph, checked."""
    return _tiling_check(sectioning.tile_graph(part_graph(spark, sf_dir), _layers(spark, sf_dir), TILES), part_nodes(spark, sf_dir))


def simple_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiling of the part graph as one layer, checked."""
    nodes = part_nodes(spark, sf_dir)
    return _tiling_check(sectioning.simple_tiling(part_graph(spark, sf_dir), nodes, TILES), nodes)


def triangular_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower triangle of the part graph in independent layers, checked: vertices, columns that two tiles of a layer use."""
    edges, nodes = materialize(part_graph(spark, sf_dir).filter("src >= dst"), "edges"), part_nodes(spark, sf_dir)
    found = materialize(sectioning.triangular_layers(edges, nodes, TILES), "found")
    low = edges.select("src", "dst").unionByName(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst")))
    used = low.join(found.withColumnRenamed("id", "src"), "src").groupBy("layer", "dst").agg(F.min("tile").alias("a"), F.max("tile").alias("b"))
    one = nodes.join(found.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id", "left").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.coalesce("n", F.lit(0)) != 1).alias("misplaced"))
    return one.join(F.broadcast(used.agg(F.count_if(F.col("a") != F.col("b")).alias("conflicts"))))  # one row and one row


def balanced_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part graph cut in equal parts, checked: parts outside the slack, and whether fewer edges are cut than by equal shares of ids."""
    edges, nodes = part_graph(spark, sf_dir), part_nodes(spark, sf_dir)
    edges = materialize(edges, "edges")
    found = sectioning.balanced_partition(edges, nodes, TILES)
    n = nodes.count()
    got, start = (sectioning.cut_size(edges, p).first() for p in (found, sectioning.balanced_partition(edges, nodes, TILES, rounds=0)))
    within = got.least >= min(n // TILES, n / TILES * 0.97) and got.most <= max(-(-n // TILES), n / TILES * 1.03)
    return found.agg(F.count_distinct("id").alias("nodes"), F.count_distinct("tile").alias("tiles")).select("nodes", "tiles", F.lit(within).alias("balanced"), F.lit(got.cut <= start.cut).alias("no_worse"))


def proper_coloring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part graph coloured, checked: vertices with exactly one colour, and edges with equal colours at both ends."""
    edges, nodes = materialize(part_graph(spark, sf_dir), "edges"), part_nodes(spark, sf_dir)
    found = materialize(sectioning.proper_coloring(edges, nodes), "found")
    a, b = (found.select(F.col("id").alias(c), F.col("color").alias(f"c_{c}")) for c in ("src", "dst"))
    bad = edges.join(a, "src").join(b, "dst").agg(F.count_if(F.col("c_src") == F.col("c_dst")).alias("conflicts"))
    one = nodes.join(found.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id", "left").agg(F.count_if(F.col("n") == 1).alias("colored"))
    return one.join(F.broadcast(bad))  # one row and one row


def grid_stencil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir)[0]


def mtx_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of orders and parts, written as Matrix Market text in several files and read again."""
    path = scratch(spark, "matrix.mtx")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    write_matrix_market(order_part_matrix(spark, sf_dir), path, rows, _part(spark, sf_dir).count(), per_file=20_000)
    return read_matrix_market(spark, path)[0]


def _mtx(kind: str, valued: bool, more: int = 0) -> Query:
    """The lower triangle of the part graph as a text of ``kind`` in four files, read again; ``more``: entries outside the size."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path, n = scratch(spark, "matrix.mtx"), _part(spark, sf_dir).count()
        line = F.concat_ws(" ", F.col("src") + 1, F.col("dst") + 1, *([F.col("src") * 3 + F.col("dst")] if valued else []))
        body = part_graph(spark, sf_dir).filter("src > dst").select("src", "dst", line.alias("value"))
        if valued:  # an entry that reads like the size line
            body = body.unionByName(spark.createDataFrame([(n, n, f"{n} {n} 7")], body.schema))
        if more:
            body = body.unionByName(spark.range(more).select(F.col("id").alias("src"), F.lit(n).cast("long").alias("dst"), F.concat_ws(" ", F.col("id") + 1, F.lit(n + 1), F.lit(5)).alias("value")))
        head = [f"%%MatrixMarket matrix coordinate {'real' if valued else 'pattern'} {kind}", "% a comment", "", f"{n} {n} 7"]
        whole = body.unionByName(spark.createDataFrame([(-1, i, x) for i, x in enumerate(head)], body.schema))
        whole.repartitionByRange(4, "src", "dst").sortWithinPartitions("src", "dst").select("value").write.text(path)
        return read_matrix_market(spark, path)[0]

    return query


QUERIES: dict[str, Query] = {
    **{f.__name__: f for f in (
        hash_colors, scalar_functions, tile_costs, node_degree, max_degree, degree_prefix, d1_per_node, d1_collisions, d2_per_node, d2_collisions,
        d1_bipartite, d2_bipartite, best_parameters, symmetrize, drop_self_loops, pattern_symmetry, spmv, spmv_float, vector_permute, vector_unpermute,
        matrix_permute, matrix_unpermute, compare_summary, equipartition, work_distribution, tile_stats, layer_sizes, slice_stats, layer_major_order,
        tile_major_order, tile_starts, bar_sizes, border_first_order, border_offsets, redundancy_stats, coarsen_layers, coarsen_single,
        triangular_layers, balanced_partition, proper_coloring, grid_stencil, mtx_roundtrip, tile_view, single_offsets, redundancy_single, bits_order,
        duration_stats, compare_tiles, matrix_permute_float, capacity_cut, cut_layers, cut_weights, tile_graph, simple_tiling,
    )},
    "sectioning": sectioning_quality,
    "mtx_symmetric": _mtx("symmetric", True),
    "mtx_skew": _mtx("skew-symmetric", True),
    "mtx_pattern": _mtx("symmetric", False),
    "mtx_out_of_range": _mtx("general", True, more=50),
    **{f"greedy_tiles_{v}": _greedy(v) for v in TILE_COSTS},
}
