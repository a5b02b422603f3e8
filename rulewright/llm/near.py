"""Near-duplicate documents by an LSH forest over MinHash signatures.

The forest sorts the signatures in several orders, each starting at another part of the
signature. In each order the documents that share the first values are a region, and within a
region the neighbours with the longest common prefixes are candidates. A crowded region is
sorted to a greater depth and split there, the deeper the more documents it has, so that no
task holds a large one; its members are also candidates with the region's least document, which
keeps the parts together. Candidates whose signatures agree enough are confirmed on their full
shingle sets.

A document of a crowded region isn't compared with every other one there. So that no link
between two groups is lost, all documents of such regions are matched once more, exactly: two
linked documents share one of their rarest shingles (the prefix filter of set joins), and only
pairs that aren't in one group yet are formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulewright.llm.common import BROADCAST_IDS, fresh, grams, mix64, slices, stored, text_column, word_hashes
from rulewright.llm.components import components

SHINGLE_WORDS = 5
VALUES, TREES = 64, 16
NEIGHBOURS = 8
#: Documents in a region from which on it is split, and further values that may split it.
REGION, DEEPER = 64, 12
#: In one of so many trees a document of a crowded region also has its nearest neighbour as a candidate.
CROWDED_TREES = 4
#: Documents of a region that even its deepest part is dealt out by, so that no task holds more.
SALT_ROWS = 1 << 16
#: 64-bit words of the marks by which sets of crowded regions are compared before they are joined; a power of two.
BIT_WORDS = 8

_RNG = np.random.default_rng(20240607)
_MUL = _RNG.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, VALUES, dtype=np.uint64)


def shingle_set(text: np.ndarray, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; A-Z count as lower case."""
    return np.unique(grams(word_hashes(text, lower=True), words))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least of each of VALUES 32-bit hashes over a set that isn't empty."""
    out = np.full(VALUES, np.iinfo(np.uint32).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 4096):
            part = (shingles[None, at : at + 4096] * _MUL[:, None] + _ADD[:, None]) >> np.uint64(32)
            np.minimum(out, part.min(axis=1), out=out)
    return out.astype(np.uint32)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in slices(batches, "text"):
        data, offsets = text_column(batch, "text")
        yield batch, [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def marked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(key, mark, text) of each row; the mark tells rows of one doc_id with different texts apart."""
    return docs.select(F.col(doc_id).cast("long").alias("key"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))


def sketches(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(key, mark, n_shingles, set_a, set_b, sig) of each row of (key, mark, text); equal sets have equal set_a, set_b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches):
            sets = [shingle_set(t, words) for t in texts]
            sigs = [signature(s) if len(s) else np.zeros(VALUES, np.uint32) for s in sets]
            with np.errstate(over="ignore"):
                a = np.array([mix64(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                b = np.array([mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) for s in sets], np.uint64)
            flat = pa.array(np.concatenate(sigs).view(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([len(s) for s in sets], pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * VALUES), flat)],
                names=["key", "mark", "n_shingles", "set_a", "set_b", "sig"],
            )

    return docs.mapInArrow(run, "key long, mark long, n_shingles long, set_a long, set_b long, sig array<int>")


def _shingle_arrays(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches):
            sets = [shingle_set(t, words) for t in texts]
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], names=["rep", "shingles"])

    return docs.select("rep", "text").mapInArrow(run, "rep long, shingles array<long>")


def forest_candidates(reps: DataFrame, prefix: int) -> tuple[DataFrame, DataFrame]:
    """Distinct candidate pairs a < b among rows (rep, sig), and the documents of crowded regions (rep)."""
    reps = reps.select("rep", "sig")
    step = VALUES // TREES
    keys = [F.struct(F.lit(t).alias("tree"), F.xxhash64(*[F.get("sig", F.lit((t * step + i) % VALUES)) for i in range(prefix)]).alias("key")) for t in range(TREES)]
    rows = reps.select("rep", F.explode(F.array(*keys)).alias("x")).select("rep", "x.tree", "x.key")
    regions = rows.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("first")).filter("size > 1")
    # a document is in one region of each tree, so this list has TREES entries at most
    members = stored(rows.join(regions, ["tree", "key"]).groupBy("rep").agg(F.collect_list(F.struct("tree", "key", "size", "first")).alias("in")))
    twice = reps.select("rep", F.concat("sig", "sig").alias("twice")).join(members, "rep").select("rep", "twice", F.explode("in").alias("x"))
    more = F.least(F.lit(DEEPER), F.greatest(F.lit(0), F.ceil(F.log2(F.col("x.size") / REGION)).cast("int")))
    deep = F.slice("twice", F.col("x.tree") * step + prefix + 1, DEEPER)
    placed = twice.select(
        "rep", "x.first", "x.tree", "x.key", "x.size", deep.alias("deep"), F.when(more > 0, F.xxhash64(F.slice(deep, F.lit(1), more))).otherwise(F.lit(0)).alias("part"),
        F.when(more == DEEPER, F.pmod(F.xxhash64("rep"), F.ceil(F.col("x.size") / SALT_ROWS))).otherwise(F.lit(0)).alias("salt"),
    )
    order = Window.partitionBy("tree", "key", "part", "salt").orderBy("deep", "rep")
    near = placed.select("rep", "size", "tree", F.array("first", *[F.lag("rep", i).over(order) for i in range(1, NEIGHBOURS + 1)]).alias("others"))
    # documents of crowded regions are matched exactly later on: here a few of their neighbours do
    sparse = F.when(F.col("tree") % CROWDED_TREES == 0, F.slice("others", 1, 2)).otherwise(F.slice("others", 1, 1))
    near = near.select("rep", F.when(F.col("size") > NEIGHBOURS + 1, sparse).otherwise(F.col("others")).alias("others"))
    pairs = near.select("rep", F.explode("others").alias("other")).filter("other is not null and other <> rep")
    crowded = members.filter(F.exists("in", lambda x: x["size"] > NEIGHBOURS + 1)).select("rep")
    return pairs.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct(), crowded


def fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the columns of ``wanted`` (key, mark, rep) to them; up to BROADCAST_IDS rows are broadcast."""
    small = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(wanted) if small else wanted.hint("shuffle_hash"), ["key", "mark"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left, right = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").filter(both * 100 >= (F.size("sa") + F.size("sb") - both) * percent).select("a", "b")


def crowded_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """All pairs a < b of rows (rep, component, shingles) in different components that may be similar enough.

    If two sets have that similarity, they share one of the first n - ceil(n * percent / 100) + 1
    shingles of either, in any one order of all shingles; here the rarest come first. From the first
    shingle that they share on, both must have as many as the similarity asks them to share. And
    each shingle in only one of two sets turns one of the 64 * BIT_WORDS bits of their marks at most, so marks that differ in more bits
    than the similarity leaves shingles to differ in are no pair. The join forms no others.
    """
    each = sets.select("rep", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("docs"), F.min("component").alias("low"), F.max("component").alias("high"))
    word, bit = F.shiftrightunsigned("shingle", 6).bitwiseAND(F.lit(BIT_WORDS - 1)), F.expr("shiftleft(1L, cast(shingle & 63 as int))")
    marks = [F.coalesce(F.bit_xor(F.when(word == i, bit)), F.lit(0)).alias(f"m{i}") for i in range(BIT_WORDS)]
    # shingles of one document or one component stand in the order but form no pairs
    ranked = each.join(often, "shingle").groupBy("rep", "component", "n").agg(F.array_sort(F.collect_list(F.struct("docs", "shingle", (F.col("low") != F.col("high")).alias("joins")))).alias("order"), *marks)
    first = F.col("n") - F.ceil(F.col("n") * percent / 100.0).cast("int") + 1
    words = [f"m{i}" for i in range(BIT_WORDS)]
    post = ranked.select("rep", "component", "n", *words, F.posexplode(F.slice("order", F.lit(1), first)).alias("at", "x")).filter("x.joins")
    post = stored(post.select("rep", "component", "n", *words, (F.col("n") - F.col("at")).alias("rest"), "x.shingle"))
    a, b = (post.select("shingle", *[F.col(c).alias(f"{x}_{c}") for c in ("rep", "component", "n", "rest", *words)]) for x in "ab")
    na, nb = F.col("a_n"), F.col("b_n")
    apart = (F.col("a_rep") < F.col("b_rep")) & (F.col("a_component") != F.col("b_component")) & (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent)
    enough = F.least("a_rest", "b_rest") * (100 + percent) >= (na + nb) * percent
    turned = sum((F.bit_count(F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}"))) for w in words[1:]), F.bit_count(F.col("a_m0").bitwiseXOR(F.col("b_m0"))))
    near = turned * (100 + percent) <= (na + nb) * (100 - percent)
    return a.join(b, "shingle").filter(apart & enough & near).select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")).distinct()


def near_components(docs: DataFrame, sketched: DataFrame, percent: int, words: int) -> DataFrame:
    """(n_shingles, set_a, set_b, component_id) of each distinct set, from rows (key, mark, text) and their sketches."""
    some = sketched.filter("n_shingles > 0 and key is not null")
    reps = some.groupBy("n_shingles", "set_a", "set_b").agg(F.min(F.struct("key", "mark")).alias("first"), F.any_value("sig").alias("sig"))
    reps = stored(reps.select("n_shingles", "set_a", "set_b", "sig", "first.key", "first.mark").withColumn("rep", F.monotonically_increasing_id()))
    share = percent / 100
    prefix = max(1, min(VALUES // TREES, round(np.log(0.5) / np.log(share)))) if share < 1 else VALUES // TREES
    least = int(VALUES * share - 5 * (VALUES * share * (1 - share)) ** 0.5)
    pairs, crowded = forest_candidates(reps, prefix)
    ends = pairs.join(reps.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa")), "a").join(
        reps.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb")), "b"
    )
    agree = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    close = ends.filter((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (agree >= least))
    close, crowded = stored(close.select("a", "b")), stored(crowded)
    ids = close.select(F.explode(F.array("a", "b")).alias("rep")).unionByName(crowded).distinct()
    wanted = stored(reps.select("key", "mark", "rep").join(ids, "rep", "left_semi"))
    sets = stored(_shingle_arrays(fetched(docs, wanted), words).dropDuplicates(["rep"]))
    joined = components(confirmed(close, sets, percent))
    if not crowded.isEmpty():
        of = joined.select(F.col("node").alias("rep"), "component")
        apart = sets.join(crowded, "rep", "left_semi").join(of, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        more = confirmed(crowded_pairs(apart, percent), sets, percent)
        joined = components(more.unionByName(joined.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    placed = stored(reps.drop("sig").join(joined, reps["rep"] == joined["node"], "left").withColumn("component", F.coalesce("component", "rep")))
    least_id = placed.groupBy("component").agg(F.min("key").alias("component_id"))
    return placed.join(least_id, "component").select("n_shingles", "set_a", "set_b", "component_id")


def _groups(docs: DataFrame, percent: int, words: int) -> DataFrame:
    sketched = stored(sketches(docs, words))
    of_set = near_components(docs, sketched, percent, words)
    rows = sketched.drop("sig").join(of_set, ["n_shingles", "set_a", "set_b"], "left")
    return rows.select("key", "mark", "n_shingles", F.when(F.col("key").isNotNull(), F.coalesce("component_id", "key")).alias("component_id"))


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80, words: int = SHINGLE_WORDS) -> DataFrame:
    """Near-duplicate groups: doc_id, n_shingles, component_id, kept; one row for each row of ``docs``.

    Two documents are linked if 100 times the shingles they share is at least ``percent`` times
    the shingles of both. A text with fewer than ``words`` words has its whole sequence as one
    shingle; null and empty texts have none and are linked with nothing. component_id is the
    smallest doc_id reachable over links, and its row stays. Shingles are compared by 64-bit
    hashes. A null doc_id is linked with nothing, has a null component and stays. Rows that
    repeat a doc_id with other texts are documents of their own, each with its own links; those
    that repeat both are one. An empty table gives an empty result; other columns are ignored.
    """
    rows = _groups(marked(docs, doc_id, text), percent, words)
    return rows.select(F.col("key").alias("doc_id"), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80, words: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one of the smallest doc_id; all columns stay.

    Rows with a null doc_id, and texts that are null or without words, are in no group and stay. Rows
    that repeat the doc_id and text that stay do so together, and so do texts of one doc_id. An empty
    table stays empty; columns of any other names are left as they are.
    """
    key, mark = fresh(docs, "gone_key"), fresh(docs, "gone_mark")
    gone = _groups(marked(docs, doc_id, text), percent, words).filter("key <> component_id")
    gone = stored(gone.select(F.col("key").alias(key), F.col("mark").alias(mark)).distinct())
    gone = F.broadcast(gone) if gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else gone
    return docs.join(gone, (docs[doc_id].cast("long") == F.col(key)) & (F.xxhash64(docs[text]) == F.col(mark)), "left_anti")
