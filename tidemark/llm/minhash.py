"""Near-duplicate documents by one-permutation MinHash, confirmed on full shingle sets.

A document's set is its distinct shingles of two words. Documents with equal sets are one class,
named by its smallest doc_id, before anything is compared. A class gets one permutation of
`BINS` bins: the smallest shingle hash in each. Empty bins are filled by optimal densification:
each bin tries the others in an order of its own, the same for all documents, and takes the first
that was not empty. `BANDS` bands of `BINS / BANDS` bins are buckets. Two sets that share 80 % of
their union miss each other in all buckets with probability (1 - 0.8**4)**32, below 1e-7.

In a bucket, candidates form a star: all members are compared with one centre, the member that
meets most others over all its buckets, and pairs are confirmed on the full sets. Members outside
the centre's component form the next star among themselves, as long as that links many of them.

What is left are single outsiders. One may still be linked with another document z of a first
centre c, and that is decided by how both differ from c. With D the shingles of c that a document
lacks and A those it has beyond c, two documents of c share |c| - |D1 u D2| + |A1 n A2| shingles, so a
link needs max(|D1|, |D2|) - |c| plus the shingles a link takes to be held in common by A1 and A2. Outsiders
lack so much of c that this is nearly always positive: only documents meeting in a rare enough
shingle of A (prefix filter on the counts within c's group) are candidates. Where no common
shingle of A is needed, sizes decide who is a candidate; and where not even common shingles of D
are needed, every such pair is linked with the group's document of least size and difference, so a
star around that one connects them. Candidates are confirmed on the full sets. So each pair of each
bucket is connected, refuted by counts or refuted by its sets, and no list of all pairs is made.

Joins with a hot bucket or class read both sides from tables, so that Spark can split them.

Defined cases: a document of one word has that word as its set; without words, or without text,
the set is empty and linked with nothing; rows without doc_id are linked with nothing and kept;
repeated rows are copies. doc_id names one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import words as w
from tidemark.llm.arrow import flat, lists, slices
from tidemark.llm.components import components
from tidemark.llm.store import release, settled

BINS, BANDS = 128, 32
THRESHOLD = 80


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 2) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every row; fewer words than a shingle are one shingle."""
    data = w.lower(data)
    starts, ends, first = w.spans(data, offsets, w.SPACE)
    words = w.hashes(data, starts, ends)
    grams = w.grams(words, size, 11)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        else:
            out.append(w.grams(words[a:b], int(b - a), 12 + int(b - a)) if b > a else words[:0])
    return out


def _orders(bins: int) -> np.ndarray:
    """For each bin, the order in which it tries the others."""
    tries = w.mix(np.arange(bins * bins, dtype=np.uint64) * w.GOLDEN + w.M1).reshape(bins, bins)
    return np.argsort(tries, axis=1, kind="stable")


ORDERS = _orders(BINS)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of `BINS` values per non-empty set."""
    shift = np.uint64(64 - BINS.bit_length() + 1)
    out = np.zeros((len(sets), BINS), np.uint64)
    full = np.zeros((len(sets), BINS), bool)
    for i, s in enumerate(sets):
        bins = (s >> shift).astype(np.int64)  # sorted, so the first of each bin is its least
        first = np.flatnonzero(np.diff(bins, prepend=-1))
        out[i, bins[first]] = s[first]
        full[i, bins[first]] = True
    empty = ~full
    for k in range(BINS):
        if not empty.any():
            break
        source = ORDERS[:, k]
        take = empty & full[:, source]
        out = np.where(take, out[:, source], out)
        empty &= ~take
    return out


def buckets(signed: np.ndarray) -> np.ndarray:
    """A hash per row and band."""
    parts = signed.reshape(len(signed), BANDS, BINS // BANDS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * w.GOLDEN, parts.shape[:2])
    for k in range(parts.shape[2]):
        out = w.mix((out ^ parts[:, :, k]) * w.M1 + w.GOLDEN)
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_key, buckets) of `docs` (doc_id, text); an empty set has no key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text"):
            sets = shingles(data, offsets)
            sizes = np.array([len(s) for s in sets], np.int64)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            own = buckets(signatures([s for s in sets if len(s)]))
            ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))])
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(sizes),
                    pa.array(keys, pa.binary()),
                    lists(own.ravel().view(np.int64), ends, pa.int64()),
                ],
                ["doc_id", "n_shingles", "set_key", "buckets"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, buckets array<long>")


def confirm(pairs: DataFrame, texts: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose full sets share `threshold` percent of their union."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in slices(batches, "text_a"):
            keep = np.zeros(batch.num_rows, bool)
            sets = []
            for name in ("a", "b"):  # a centre is in many pairs; its set is made once per slice
                ids, first, where = np.unique(
                    batch.column(batch.schema.get_field_index(name)).to_numpy(), return_index=True, return_inverse=True
                )
                column = batch.column(batch.schema.get_field_index(f"text_{name}")).take(pa.array(first))
                own = shingles(*flat(column))
                sets.append((own, where))
            (left_sets, at), (right_sets, to) = sets
            for i in range(batch.num_rows):
                x, y = left_sets[at[i]], right_sets[to[i]]
                if len(x) > len(y):
                    x, y = y, x
                if not len(x) or 100 * len(x) < threshold * len(y):
                    continue
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep[i] = 100 * both >= threshold * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    joined = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def links(members: DataFrame, docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, component_id) of the classes that are linked with another one.

    `members`: (doc_id, n_shingles, buckets) of one document per class.
    """
    spread = members.select("doc_id", F.col("n_shingles").alias("n"), F.explode("buckets").alias("bucket"))
    several = spread.groupBy("bucket").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("size")
    )
    several = settled(several.where("low < high").select("bucket", "size"), "shared-buckets")
    rest = settled(spread.join(several.hint("merge"), "bucket"), "bucket-members")
    met = rest.groupBy("doc_id").agg(F.sum("size").alias("met"))
    rest = settled(rest.drop("size").join(met.hint("merge"), "doc_id"), "bucket-members")
    texts = settled(
        docs.join(met.select("doc_id").hint("merge"), "doc_id", "left_semi").select("doc_id", "text"), "bucket-texts"
    )
    release(docs)

    first, edges, labels = _stars(rest), None, None
    stars, inside = first, 0.0
    while True:
        near = (F.col("doc_id") != F.col("centre")) & _sizes_allow("n", "m", threshold)
        pairs = stars.where(near).select(F.col("doc_id").alias("a"), F.col("centre").alias("b")).distinct()
        found = settled(confirm(pairs, texts, threshold), "links")
        if found.isEmpty():
            break
        edges = found if edges is None else edges.unionByName(found)
        labels = components(edges)
        outside = settled(_outside(stars, labels), "outside")
        left = outside.select("doc_id").distinct().count()
        if not left or (inside and left > 0.9 * inside):
            break
        stars, inside = _stars(outside), left
    if labels is None:  # no star has a link, so each class is a component of its own
        labels = members.select("doc_id", F.col("doc_id").alias("component_id")).limit(0)
    more = settled(confirm(_rest(first, labels, texts, threshold), texts, threshold), "more-links")
    if more.isEmpty():
        return labels
    return components(more if edges is None else edges.unionByName(more))


def _stars(rest: DataFrame) -> DataFrame:
    """(bucket, doc_id, n, met, centre, m): every member of a bucket with its centre."""
    centres = rest.groupBy("bucket").agg(F.min(F.struct(-F.col("met"), "doc_id", "n")).alias("c"), F.count(F.lit(1)).alias("k"))
    centres = centres.where("k > 1").select("bucket", F.col("c.doc_id").alias("centre"), F.col("c.n").alias("m"))
    return settled(rest.join(settled(centres, "centres").hint("merge"), "bucket"), "stars")


def _named(rows: DataFrame, labels: DataFrame, by: str, name: str) -> DataFrame:
    labels = labels.select(F.col("doc_id").alias("_id"), F.col("component_id").alias("_c"))
    joined = rows.join(labels.hint("merge"), F.col(by) == F.col("_id"), "left")
    return joined.withColumn(name, F.coalesce("_c", by)).drop("_id", "_c")


def _outside(stars: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of buckets outside the component of their centre."""
    rows = _named(_named(stars, labels, "doc_id", "comp"), labels, "centre", "main")
    return rows.where("comp <> main").select("bucket", "doc_id", "n", "met")


def _sizes_allow(x: str, y: str, threshold: int):
    return (F.col(x) * 100 >= F.col(y) * threshold) & (F.col(y) * 100 >= F.col(x) * threshold)


def differences(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, centre, removed, added): shingles the centre has alone, counted, and the document alone."""
    left = texts.select("doc_id", F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("centre"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text_a"):
            own = shingles(data, offsets)
            other, first, where = np.unique(batch.column(1).to_numpy(), return_index=True, return_inverse=True)
            centres = shingles(*flat(batch.column(3).take(pa.array(first))))
            added = [np.setdiff1d(x, centres[k], assume_unique=True) for x, k in zip(own, where, strict=True)]
            removed = [len(centres[k]) - len(x) + len(y) for x, y, k in zip(own, added, where, strict=True)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in added])])
            flat_added = np.concatenate([*added, np.empty(0, np.uint64)]).view(np.int64)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), lists(flat_added, ends, pa.int64())],
                ["doc_id", "centre", "removed", "added"],
            )

    joined = pairs.join(left.hint("merge"), "doc_id").join(right.hint("merge"), "centre")
    return joined.select("doc_id", "centre", "text_a", "text_b").mapInArrow(
        run, "doc_id long, centre long, removed long, added array<long>"
    )


def _rest(stars: DataFrame, labels: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) of one centre that are not connected and whose differences from it allow a link."""
    rows = stars.where("doc_id <> centre").select("doc_id", "n", "centre", "m").distinct()
    rows = settled(_named(_named(rows, labels, "doc_id", "comp"), labels, "centre", "main"), "centre-groups")
    mixed = rows.groupBy("centre").agg(F.count_if(F.expr("comp <> main")).alias("out"), F.count(F.lit(1)).alias("k"), F.min("n").alias("least"))
    mixed = settled(mixed.where("out > 0 AND k > 1").select("centre", "least"), "mixed-groups")
    rows = settled(rows.join(mixed.hint("merge"), "centre"), "mixed-rows")
    differ = settled(differences(rows.select("doc_id", "centre"), texts), "differences")

    # Shingles that another document of the group has added as well, rare ones first.
    added = differ.select("centre", "doc_id", F.explode("added").alias("shingle"))
    common = added.groupBy("centre", "shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    added = settled(added.join(settled(common, "common-shingles").hint("merge"), ["centre", "shingle"]), "common-added")
    held = settled(added.groupBy("centre", "doc_id").agg(F.count(F.lit(1)).alias("held")), "held")
    rows = rows.join(differ.drop("added").hint("merge"), ["centre", "doc_id"])
    rows = rows.join(held.hint("merge"), ["centre", "doc_id"], "left").withColumn("held", F.coalesce("held", F.lit(0)))
    whole = 100 + threshold

    def taken(n, m):  # shingles that a link between sets of these sizes has in common
        return F.ceil((n + m) * threshold / F.lit(whole)).cast("long")

    rows = rows.withColumn("takes", taken(F.col("n"), F.col("least")) - F.col("m") + F.col("removed"))
    rows = settled(rows.withColumn("weight", F.col("n") * threshold + F.col("removed") * whole), "compared-rows")
    right = rows.select("centre", "doc_id", "n", "comp", "main", "removed", "held", "weight", "m")
    left = rows.where("comp <> main").select(
        "centre", "least", *(F.col(c).alias(f"{c}_a") for c in ("doc_id", "n", "comp", "removed", "held", "takes", "weight"))
    )
    apart = (F.col("comp_a") != F.col("comp")) & ((F.col("comp") == F.col("main")) | (F.col("doc_id_a") < F.col("doc_id")))
    needs = taken(F.col("n"), F.col("n_a")) - F.col("m") + F.greatest("removed", "removed_a")

    order = Window.partitionBy("centre", "doc_id").orderBy("df", "shingle")
    prefix = added.withColumn("place", F.row_number().over(order)).withColumnRenamed("doc_id", "doc_id_a")
    prefix = prefix.join(left.hint("merge"), ["centre", "doc_id_a"])
    prefix = settled(prefix.where("place <= held_a - greatest(takes_a, 1) + 1").drop("place", "df"), "prefixes")
    added = settled(added.drop("df").join(right.hint("merge"), ["centre", "doc_id"]), "added")
    met = _on(prefix, added, ["centre", "shingle"], apart & (needs >= 1) & (needs <= F.least("held", "held_a")))

    thin = apart & (needs <= 0) & (F.col("weight") + F.col("weight_a") > F.col("m") * whole)
    sized = _on(settled(left.where("takes_a <= 0"), "thin"), right, ["centre"], thin)

    light = rows.groupBy("centre").agg(F.min(F.struct("weight", "doc_id")).alias("l"))
    light = settled(light.select("centre", F.col("l.weight").alias("weight_a"), F.col("l.doc_id").alias("doc_id_a")), "lightest")
    sure = _on(light, right, ["centre"], (F.col("weight") + F.col("weight_a") <= F.col("m") * whole) & (F.col("doc_id") != F.col("doc_id_a")))
    return settled(met.unionByName(sized).unionByName(sure).distinct(), "candidate-pairs")


def _on(left: DataFrame, right: DataFrame, keys: list[str], condition) -> DataFrame:
    """(a, b) of the rows that agree in `keys` and meet the condition, which the join itself checks."""
    renamed = left.select(*(F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in left.columns))
    for k in keys:
        condition = (F.col(f"_{k}") == F.col(k)) & condition
    return renamed.hint("merge").join(right, condition).select(F.col("doc_id_a").alias("a"), F.col("doc_id").alias("b"))


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = settled(sketches(docs), "sketches")
    alone = rows.where("set_key IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    rows = rows.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    least = settled(rows.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "representatives")
    rows = settled(
        rows.join(least.hint("merge"), "set_key").select(
            "doc_id", "n_shingles", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("buckets")).alias("buckets")
        ),
        "classes",
    )
    linked = links(rows.where("buckets IS NOT NULL"), docs, threshold).withColumnRenamed("doc_id", "rep")
    done = (
        rows.join(linked.hint("merge"), "rep", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "rep").alias("component_id"))
        .unionByName(alone)
    )
    return done.select(
        F.col("doc_id").alias(id_col),
        "n_shingles",
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, one document per component; rows repeated in full stay one."""
    gone = cluster(docs, id_col, text_col, threshold).where("NOT kept").select(F.col(id_col).alias("_id")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("_id"), "left_anti")
