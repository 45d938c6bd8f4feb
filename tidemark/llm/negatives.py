"""Hard negatives for anchors, by shared candidate lists of anchor clusters with a certified end.

Anchors are clustered by direction. The angle between a candidate and an anchor is at least the
candidate's angle to the cluster's centre less the cluster's radius, so |candidate| * cos(that) times the
anchor's length bounds the inner product. Every cluster sorts the candidates by this bound once, and all
its members walk that list; a member stops as soon as the bound of what follows is below the worst
score it still holds (or may still take), which certifies that nothing was missed.

In Spark the list is made of blocks. Candidates lie in blocks of at most `BLOCK`, of one label and around
one centre, with the least and largest length and angle of their members. A cluster orders the blocks by
the same bound and cuts the order into pages of `PAGE` blocks. Each (cluster, page) is one task of
a cogroup: it sorts the page's candidates, and its anchors walk. The first page of every cluster is
walked first; its results give each anchor a floor, and of the other pages only those go on that hold
a block whose bound reaches the lowest floor of the cluster. So there are two rounds, whatever the size.

Rows of equal label and vector are one node with their smallest ids (more can never be returned), and
anchors of one node share one search. Positives are searched first, among nodes of the anchor's label;
negatives then, between the scores that each positive allows.

Scores are exact whole numbers: products of lengths below 2**52 are multiplied in double precision,
which is exact there, others in 64-bit integers. Bounds are rounded up.

Where the vectors' directions are spread evenly in many dimensions the bounds exclude little, and the
work is anchors times rows, in blocks. What is bounded: at most `CENTRES` centres, learned on at most 16
anchors each, are broadcast with one radius each.

Defined cases: rows with a null vec_id, label or vector, or with null or non-finite components, take no
part, nor do vectors of a length of 2**31 or more after scaling, whose products have no 64-bit form. Of
rows that share a vec_id one takes part, the least by label and vector. Vectors of unequal numbers of
components are compared as if zeros followed the shorter; a vector without components or of zeros scores
0 with all. Negative positive scores allow no negative. Empty tables and tables without anchors give no
rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tidemark.llm.store import settled

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Anchors in a cluster, candidates in a block, blocks on a page.
CLUSTER, BLOCK, PAGE = 1024, 2048, 8
CENTRES, LEARNED_ON = 1024, 16
CHUNK = 512
FAR = 1 << 62
SLACK = 1e-6


def prepared(table: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, x, norm) of the rows that take part, x in whole numbers."""
    value = F.col(vector_col).cast("array<double>")
    sound = F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    number, label = F.col(id_col).cast("long"), F.col(label_col).cast("long")
    rows = table.where(number.isNotNull() & label.isNotNull() & value.isNotNull() & sound).select(
        number.alias("vec_id"),
        F.when(number % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform(value, lambda v: F.floor(v * SCALE)).alias("x"),
    )
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    rows = rows.withColumn("norm", norm).where(F.col("norm") < float(1 << 31))
    least = rows.groupBy("vec_id").agg(F.min(F.struct("label", "x", "norm")).alias("r"))
    return least.select("vec_id", "r.label", F.col("r.x").cast("array<int>").alias("x"), "r.norm")


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column, cut or filled up with zeros to `width`."""
    cells = column.combine_chunks()
    cells = pa.concat_arrays(cells.chunks) if isinstance(cells, pa.ChunkedArray) else cells
    sizes = np.asarray(cells.value_lengths())
    values = cells.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return values.reshape(len(sizes), width).astype(np.float64)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row[place < width], place[place < width]] = values[place < width]
    return out


def angles(x: np.ndarray, norm: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Angle of every row to every centre; 0 for rows without direction."""
    cos = x @ centres.T / np.where(norm > 0, norm, 1.0)[:, None]
    return np.where(norm[:, None] > 0, np.arccos(np.clip(cos, -1.0, 1.0)), 0.0)


def learn_centres(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Directions of `k` spherical k-means clusters."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    centres = x[:k].copy()
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    return centres


def assigned(nodes: DataFrame, centres) -> DataFrame:
    """`nodes` with the nearest centre (`cell`) and the angle to it."""
    schema = StructType([*nodes.schema.fields, StructField("cell", IntegerType()), StructField("angle", DoubleType())])

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            own = matrix(table["x"], centres.value.shape[1])
            found = angles(own, table["norm"].to_numpy(), centres.value)
            cell = found.argmin(axis=1) if len(own) else np.zeros(0, np.int64)
            table = table.append_column("cell", pa.array(cell.astype(np.int32)))
            table = table.append_column("angle", pa.array(found[np.arange(len(own)), cell]))
            yield from table.to_batches()

    return nodes.mapInArrow(run, schema)


def dealt(rows: DataFrame, keys: list[str], most: int, name: str) -> DataFrame:
    """`rows` with `name`: groups by `keys`, those of more than `most` rows cut by hash."""
    counts = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).alias("_parts"))
    part = F.pmod(F.xxhash64("node", F.lit(name)), F.col("_parts"))
    return rows.join(counts, keys).withColumn(name, F.concat_ws("/", *keys, part)).drop("_parts")


def walk(anchors: pa.Table, page: pa.Table, centre: np.ndarray, same: bool, depth: int) -> pa.Table:
    """For each anchor and each of its ranges the first `depth` of the page's candidates: (node, p, score, vec_id).

    A range p takes scores from `low` to `high`. `same`: only candidates of the anchor's label, else only others.
    """
    width = max(int(np.asarray(pc.max(pc.list_value_length(anchors["x"])).as_py() or 0)), 1)
    a, c = matrix(anchors["x"], width), matrix(page["x"], max(width, len(centre)))
    size, norm = anchors["norm"].to_numpy(), page["norm"].to_numpy()
    away = angles(c[:, : len(centre)], norm, centre[None, :])[:, 0]
    c = c[:, :width]
    bound = norm * (np.minimum(np.cos(np.maximum(away - anchors["angle"].to_numpy().max(), 0.0)), 1.0) + SLACK)
    order = np.argsort(-bound, kind="stable")  # the list, sorted once for all anchors
    c, bound = c[order], bound[order]
    if size.max(initial=0) * norm.max(initial=0) >= float(1 << 52):
        a, c = a.astype(np.int64), c.astype(np.int64)
    ids = page["ids"].combine_chunks()
    entry_of = np.repeat(np.arange(len(order)), np.asarray(ids.value_lengths()))
    flat, starts = ids.flatten().to_numpy(), np.searchsorted(entry_of, np.arange(len(order) + 1))
    label, labels = anchors["label"].to_numpy(), page["label"].to_numpy()[order]
    ranges = [list(zip(*x, strict=True)) for x in zip(*(anchors[k].to_pylist() for k in ("p", "low", "high")), strict=True)]
    slots = max(map(len, ranges), default=0)
    low, high = np.full((len(a), slots), FAR, np.int64), np.full((len(a), slots), -FAR, np.int64)
    for i, own in enumerate(ranges):
        for k, (_, lo, hi) in enumerate(own):
            low[i, k], high[i, k] = lo, hi
    held = [(np.empty(0, np.int64),) * 3 for _ in range(slots)]  # anchor, score, id
    active = np.arange(len(a))
    for at in range(0, len(order), CHUNK):
        reach = bound[at] * size[active] * (1 + 1e-9) + SLACK  # what the rest of the list can score
        active = active[((low[active] <= high[active]) & (reach[:, None] >= low[active])).any(axis=1)] if slots else active[:0]
        if not len(active):
            break
        part = slice(at, at + CHUNK)
        scores = (a[active] @ c[part].T).astype(np.int64)
        fits = (label[active][:, None] == labels[part][None, :]) == same
        for k in range(slots):
            row, col = np.nonzero(fits & (scores >= low[active, k][:, None]) & (scores <= high[active, k][:, None]))
            if not len(row):
                continue
            source = order[at + col]
            many = starts[source + 1] - starts[source]
            place = np.repeat(starts[source] - np.cumsum(many) + many, many) + np.arange(many.sum())
            found = (np.repeat(active[row], many), np.repeat(scores[row, col], many), flat[place])
            who, score, number = (np.concatenate(x) for x in zip(held[k], found, strict=True))
            best = np.lexsort((number, -score, who))
            who, score, number = who[best], score[best], number[best]
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            keep = rank < depth
            last = rank == depth - 1
            low[who[last], k] = score[last]
            held[k] = (who[keep], score[keep], number[keep])
    who = np.concatenate([x[0] for x in held]) if held else np.empty(0, np.int64)
    p = [ranges[i][k][0] for k, x in enumerate(held) for i in x[0]]
    return pa.table(
        {
            "node": anchors["node"].take(pa.array(who)),
            "p": pa.array(p, pa.int64()),
            "score": pa.array(np.concatenate([x[1] for x in held]) if held else [], pa.int64()),
            "vec_id": pa.array(np.concatenate([x[2] for x in held]) if held else [], pa.int64()),
        }
    )


def first_of(found: DataFrame, depth: int) -> DataFrame:
    """The first `depth` by score and id for each node and range, with their rank."""
    order = Window.partitionBy("node", "p").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth)


def search(queries: DataFrame, blocks: DataFrame, pairs: DataFrame, centres, same: bool, depth: int) -> DataFrame:
    """(node, p, score, vec_id, rank) for `queries` with their ranges (p, low, high).

    `pairs` (cluster, page, block, bound) are the clusters' lists, `blocks` the candidates.
    """

    def run(queries: DataFrame, pairs: DataFrame) -> DataFrame:
        sheets = pairs.select(F.col("cluster").alias("_of"), F.col("page").alias("_sheet")).distinct()
        anchors = queries.join(sheets, F.col("cluster") == F.col("_of"))
        page = pairs.select("cluster", "page", "block").join(blocks, "block").select("cluster", "page", "label", "x", "norm", "ids")

        def task(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                left, right = left.slice(0, 0), right.slice(0, 0)
                return pa.table({"node": left["node"], **{c: pa.array([], pa.int64()) for c in ("p", "score", "vec_id")}})
            return walk(left.combine_chunks(), right.combine_chunks(), centres.value[left["cell"][0].as_py()], same, depth)

        return (
            anchors.groupBy("_of", "_sheet")
            .cogroup(page.groupBy("cluster", "page"))
            .applyInArrow(task, "node string, p long, score long, vec_id long")
        )

    first = settled(run(queries, pairs.where("page = 0")), "negatives-first")
    floors = first_of(first, depth).groupBy("node", "p").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    floors = floors.where(F.col("n") == depth).groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("p", "least"))).alias("floor"))
    raised = F.transform(F.arrays_zip("p", "low"), lambda r: F.coalesce(F.try_element_at("floor", r["p"]), r["low"]))
    second = settled(queries.join(floors, "node", "left").withColumn("low", raised).drop("floor"), "negatives-floors")
    lowest = F.array_min(F.filter(F.transform(F.arrays_zip("low", "high"), lambda r: F.when(r["low"] <= r["high"], r["low"])), lambda v: v.isNotNull()))
    need = F.when(F.col("norm") > 0, lowest / F.col("norm")).otherwise(F.when(lowest.isNotNull(), -float(FAR)))
    needs = second.groupBy("cluster").agg(F.min(need).alias("need"))
    # A page's tasks need only blocks that can still matter to one of the cluster's anchors.
    rest = pairs.where("page > 0").join(needs, "cluster").where(F.col("bound") * (1 + 1e-9) + SLACK >= F.col("need"))
    more = run(second, settled(rest.drop("need"), "negatives-rest"))
    return settled(first_of(first.unionByName(more), depth), "negatives-found")


def lists(blocks: DataFrame, radius: dict[int, float], centres) -> DataFrame:
    """(cell, block, label, bound): the bound of each block for the clusters of each cell that has any."""
    stats = blocks.groupBy("block", "label", "cell").agg(
        F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.min("norm").alias("least"), F.max("norm").alias("most")
    )
    cells = np.array(sorted(radius), np.int64)
    wide = np.array([radius[k] for k in cells])

    def run(batches):
        mine = centres.value[cells]
        for batch in batches:
            lo, hi, least, most = (batch.column(k).to_numpy()[:, None] for k in (3, 4, 5, 6))
            between = np.arccos(np.clip(centres.value[batch.column(2).to_numpy()] @ mine.T, -1.0, 1.0))
            cos = np.minimum(np.cos(np.maximum(np.maximum(between - hi, lo - between) - wide - SLACK, 0.0)), 1.0) + SLACK
            bound = np.where(cos >= 0, most * cos, least * cos)
            n, k = bound.shape
            repeated = pa.array(np.repeat(np.arange(n), k))
            yield pa.record_batch(
                [
                    pa.array(np.tile(cells, n).astype(np.int32)),
                    batch.column(0).take(repeated),
                    batch.column(1).take(repeated),
                    pa.array(bound.ravel()),
                ],
                ["cell", "block", "label", "bound"],
            )

    return stats.mapInArrow(run, "cell int, block string, label long, bound double")


def paged(pairs: DataFrame) -> DataFrame:
    order = Window.partitionBy("cluster").orderBy(F.col("bound").desc(), "block")
    pairs = pairs.withColumn("page", F.floor((F.row_number().over(order) - 1) / PAGE))
    return settled(pairs.select("cluster", "page", "block", "bound"), "negatives-lists")


def _hundredths(value: Column, times: int, more: int) -> Column:
    """(value * times + more) / 100 in whole numbers, value not negative, without leaving 64 bits."""
    return F.call_function("div", value, F.lit(100)) * times + F.call_function("div", value % 100 * times + more, F.lit(100))


def mine(
    table: DataFrame, anchor: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `anchor`: which rows are anchors, a condition on vec_id; by default those divisible by 50.
    """
    spark = table.sparkSession
    node = F.concat(F.hex(F.xxhash64("label", "x")), F.lit("-"), F.hex(F.xxhash64("x", "label", F.lit(1)))).alias("node")
    rows = settled(prepared(table, id_col, vector_col, label_col).select("vec_id", "label", "x", "norm", node), "negatives-rows")
    members = settled(rows.where(F.col("vec_id") % 50 == 0 if anchor is None else anchor).select(F.col("vec_id").alias("anchor_id"), "node"), "negatives-anchors")

    place = F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))
    few = rows.withColumn("place", place).where(F.col("place") <= POSITIVES + 1)
    nodes = few.groupBy("node", "label", "x", "norm").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = settled(nodes, "negatives-nodes")
    queries = settled(nodes.join(members.select("node").distinct(), "node", "left_semi").drop("ids"), "negatives-queries")

    count = queries.count()
    k = min(max(-(-count // CLUSTER), 4), CENTRES, max(count, 1))
    sample = queries.select("x").orderBy(F.xxhash64("node")).limit(LEARNED_ON * k).toArrow()
    width = max([1, *(len(x) for x in sample["x"])])
    learned = learn_centres(matrix(sample["x"], width), k) if count else np.zeros((1, 1))
    centres = spark.sparkContext.broadcast(learned)

    queries = settled(assigned(queries, centres), "negatives-placed-queries")
    blocks = settled(dealt(assigned(nodes, centres), ["label", "cell"], BLOCK, "block"), "negatives-blocks")
    radius = {r.cell: r.radius for r in queries.groupBy("cell").agg(F.max("angle").alias("radius")).collect()}
    bounds = settled(lists(blocks, radius, centres), "negatives-bounds")

    whole = [F.array(F.lit(v).cast("long")).alias(c) for c, v in (("p", 0), ("low", -FAR), ("high", FAR))]
    by_label = settled(dealt(queries, ["label", "cell"], CLUSTER, "cluster").select("*", *whole), "negatives-by-label")
    clusters = by_label.select("cluster", "label", "cell").distinct()
    positives = search(by_label, blocks, paged(clusters.join(bounds, ["label", "cell"])), centres, True, POSITIVES + 1)

    wanted = positives.where("score >= 0").groupBy("node").agg(F.sort_array(F.collect_set("score")).alias("p"))
    ranged = dealt(queries.join(wanted, "node"), ["cell"], CLUSTER, "cluster").select(
        "*",
        F.transform("p", lambda p: _hundredths(p, 50, 99)).alias("low"),
        F.transform("p", lambda p: _hundredths(p, 95, 0)).alias("high"),
    )
    ranged = settled(ranged, "negatives-ranged")
    clusters = ranged.select("cluster", "cell").distinct()
    negatives = search(ranged, blocks, paged(clusters.join(bounds.drop("label"), "cell")), centres, False, NEGATIVES)

    triples = negatives.groupBy("node", "p").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("negatives"))
    own = positives.join(triples, (positives["node"] == triples["node"]) & (positives["score"] == triples["p"]), "left").select(
        positives["node"], positives["rank"], positives["vec_id"], positives["score"], "negatives"
    )
    bundle = own.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score", "negatives"))).alias("all"))
    bundle = settled(bundle, "negatives-bundles")
    others = F.slice(F.filter("all", lambda r: r["vec_id"] != F.col("anchor_id")), 1, POSITIVES)
    return (
        members.join(bundle.hint("merge"), "node")
        .select("anchor_id", F.explode(others).alias("b"))
        .select("anchor_id", F.col("b.vec_id").alias("positive_id"), F.col("b.score").alias("positive_score"), F.explode("b.negatives").alias("n"))
        .select("anchor_id", "positive_id", "n.rank", F.col("n.vec_id").alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score"))
    )
