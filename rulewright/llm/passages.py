"""Substring dedup: repeated paragraphs and passages, by MinHash banding, exact checks and components.

Two kinds of pieces of a text are compared. Whole paragraphs (lines of at least MIN_WORDS words)
get MinHash values in bands; paragraphs that share a band are joined, verified by the exact Jaccard
similarity of their word shingles, and clustered by components; the paragraphs of bands with more
members than are all paired are matched once more exactly, by a prefix filter. Passages that stand within
different paragraphs are runs of MIN_RUN words. They are looked for where documents share a stretch of STRETCH
words: a stretch begins where the shingle hash is the least of SPREAD consecutive ones, so it depends on its
own surroundings alone, and any run of STRETCH + SPREAD - 1 words (49) that two documents share
has a stretch in common. The runs of MIN_RUN words around shared stretches are then compared themselves, so what
goes is exactly what stands in an earlier document, word for word.

Of each group of paragraphs that of the smallest doc_id stays. Passages are settled among what paragraphs
leave: a run in a paragraph that goes keeps no other, and of the rest the smallest doc_id keeps it. So of every
run that goes each word stands in an earlier document that keeps it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulewright.llm.common import INVERSES, IS_BLANK, POWERS, fresh, grams, many_to_one, mix64, slices, small_batches, stored, text_column, word_hashes
from rulewright.llm.components import components
from rulewright.llm.near import confirmed, crowded_pairs, fetched, marked

SHINGLE_WORDS, MIN_WORDS, PERCENT = 5, 20, 80
STRETCH, SPREAD = 20, 30
#: The least run of words that is a repeated passage.
MIN_RUN = 50
#: Two values a band: of pairs with similarity 0.8, 1 - (1 - 0.8^2)^6 = 99.8 % share a band.
BANDS, ROWS = 6, 2
#: Paragraphs of one band that are compared with their neighbours at a time, and neighbours of each.
SLOT, NEIGHBOURS = 32, 2
#: Text that a Python worker takes apart at a time; a longer text stands alone.
SLICE_BYTES = 1 << 19

_RNG = np.random.default_rng(20240611)
_MUL = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_OTHER = np.uint64(0xA5A5A5A5A5A5A5A5)


class Document:
    """The words of one text: where they start and end (in bytes), their shingles and its paragraphs."""

    def __init__(self, data: np.ndarray, words: int):
        edge = np.diff(np.concatenate(([True], IS_BLANK[data], [True])).astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.words = word_hashes(data, lower=True)
        self.shingles = grams(self.words, words)
        self.count = len(self.starts)
        lines = np.searchsorted(self.starts, np.flatnonzero(data == 10))
        self.lines = np.unique(np.concatenate(([0], lines, [self.count])))

    def stretches(self) -> np.ndarray:
        """The words at which stretches begin."""
        n = self.count - STRETCH + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        values = self.shingles[:n]
        if n <= SPREAD:
            return np.array([int(values.argmin())])
        return np.unique(np.lib.stride_tricks.sliding_window_view(values, SPREAD).argmin(axis=1) + np.arange(n - SPREAD + 1))

    def line_of(self, word: np.ndarray) -> np.ndarray:
        """The first words of the lines in which words stand."""
        return self.lines[np.searchsorted(self.lines, word, "right") - 1]

    def paragraphs(self) -> tuple[np.ndarray, np.ndarray]:
        """First words of the paragraphs that are long enough, and the words after their last."""
        first, after = self.lines[:-1], self.lines[1:]
        long = after - first >= MIN_WORDS
        return first[long], after[long]


def _documents(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[Document]]]:
    for batch in slices(batches, "text", SLICE_BYTES):
        data, offsets = text_column(batch, "text")
        yield batch, [Document(data[a:b], words) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _sums(shingles: np.ndarray, first: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over the shingles from ``first`` to ``after``; equal ones mean equal shingles."""
    out = []
    with np.errstate(over="ignore"):
        for other in (np.uint64(0), _OTHER):
            total = np.zeros(len(shingles) + 1, np.uint64)
            np.cumsum(mix64(shingles ^ other), out=total[1:])
            out.append((total[after] - total[first]).view(np.int64))
    return out[0], out[1]


def bands_of(shingles: np.ndarray, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """BANDS keys for each run of shingles, made of ROWS least hash values each."""
    out = np.empty((len(first), BANDS), np.int64)
    if not len(first):
        return out
    edges = np.stack((first, after), axis=1).reshape(-1)
    padded = np.append(shingles, np.uint64(0))
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            key = np.full(len(first), np.uint64(band + 1), np.uint64)
            for i in range(band * ROWS, band * ROWS + ROWS):
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(mix64(padded * _MUL[i] + _ADD[i]), edges)[::2])
            out[:, band] = key.view(np.int64)
    return out


def _pieces(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "mark", "at", "from", "to", "a", "b", "line", "last_line", "bands"]
        for batch, docs in _documents(batches, words):
            owner, first, after, lines = [], [], [], [np.zeros((2, 0), np.int64)]
            bases = np.cumsum([0, *[d.count for d in docs]])
            for whole in (True, False):
                own, one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i, d in enumerate(docs):
                    if d.count >= MIN_WORDS:
                        a, b = d.paragraphs() if whole else (s := d.stretches(), s + STRETCH)
                        own.append(np.full(len(a), i))
                        one.append(a + bases[i])
                        two.append(b + bases[i])
                        if not whole:
                            lines.append(np.stack((d.line_of(a), d.line_of(b - 1))))
                for out, x in zip((owner, first, after), (own, one, two), strict=True):
                    out.append(np.concatenate(x))
            if not len(owner[1]) and not len(owner[0]):
                continue
            starts, ends = np.concatenate([d.starts for d in docs]), np.concatenate([d.ends for d in docs])
            # a document's shingles, followed by as many empty places as it has fewer shingles than words
            shingles = np.concatenate([np.concatenate((d.shingles, np.zeros(d.count - len(d.shingles), np.uint64))) for d in docs])
            for whole in (0, 1):
                of, a, b = owner[whole], first[whole], after[whole] - words + 1
                if not len(of):
                    continue
                low, high = _sums(shingles, a, b)
                bands = pa.nulls(len(of), pa.list_(pa.int64())) if whole else pa.ListArray.from_arrays(pa.array(np.arange(len(of) + 1, dtype=np.int32) * BANDS), pa.array(bands_of(shingles, a, b).reshape(-1)))
                at = np.concatenate(lines, axis=1) if whole else np.stack((a - bases[of],) * 2)
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(pa.array(of)) for c in batch.columns[:2]], pa.array((a - bases[of]).astype(np.int32)), pa.array(starts[a], pa.int64()), pa.array(ends[after[whole] - 1], pa.int64()), pa.array(low), pa.array(high), *[pa.array(x.astype(np.int32)) for x in at], bands], names=names
                )

    return run


def run_hashes(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the runs of MIN_RUN words that begin at ``starts``, rising; a run's hash is the same wherever it stands."""
    out = np.empty((2, len(starts)), np.int64)
    for low in range(0, len(words), BLOCK):
        mine = slice(*np.searchsorted(starts, (low, low + BLOCK)))
        at = starts[mine] - low
        if len(at):
            own = words[low : low + BLOCK + MIN_RUN]
            with np.errstate(over="ignore"):
                for k, other in enumerate((np.uint64(0), _OTHER)):
                    sums = np.zeros(len(own) + 1, np.uint64)
                    np.cumsum(mix64(own ^ other) * POWERS[: len(own)], out=sums[1:])
                    out[k, mine] = mix64((sums[at + MIN_RUN] - sums[at]) * INVERSES[at]).view(np.int64)
    return out[0], out[1]


#: Words of a text that are hashed with the same powers.
BLOCK = 1 << 19


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For (key, mark, seeds, gone, text): the runs of MIN_RUN words that hold a stretch of ``seeds`` (first words) and no byte of ``gone``."""
    for batch, docs in _documents(batches, SHINGLE_WORDS):
        for x, d in zip(batch.select(["key", "mark", "seeds", "gone"]).to_pylist(), docs, strict=True):
            seeds = np.unique(np.array(x["seeds"], np.int64))
            held = np.zeros(max(d.count - MIN_RUN + 1, 0) + 1, np.int64)
            if len(held) == 1:
                continue
            low, high = np.maximum(seeds + STRETCH - MIN_RUN, 0), np.minimum(seeds, len(held) - 2)
            some = low <= high
            np.add.at(held, low[some], 1)
            np.add.at(held, high[some] + 1, -1)
            removed = np.zeros(d.count + 1, np.int64)
            for g in x["gone"] or ():
                a, b = np.searchsorted(d.ends, g["from"], "right"), np.searchsorted(d.starts, g["to"])
                removed[a] += 1
                removed[b] -= 1
            lost = np.concatenate(([0], np.cumsum(np.cumsum(removed)[:-1] > 0)))
            starts = np.flatnonzero((np.cumsum(held)[:-1] > 0) & (lost[MIN_RUN:] == lost[: len(lost) - MIN_RUN]))
            n = len(starts)
            if n:
                a, b = run_hashes(d.words, starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["key"]] * n, pa.int64()), pa.array([x["mark"]] * n, pa.int64()), pa.array(d.starts[starts], pa.int64()), pa.array(d.ends[starts + MIN_RUN - 1], pa.int64()), pa.array(a), pa.array(b)], names=["key", "mark", "from", "to", "a", "b"]
                )


def shared_stretches(stretches: DataFrame) -> DataFrame:
    """Those of the rows (key, mark, at, a, b, ...) whose (a, b) more than one key has."""
    keeps = stretches.groupBy("a", "b").agg(F.min("key").alias("least"), F.max("key").alias("last"), F.count(F.lit(1)).alias("n")).filter("least < last").select("a", "b", "n")
    return many_to_one(stretches, stored(keeps), ["a", "b"], "n", ["key", "mark", "at"])


def repeated_runs(plain: DataFrame, stretches: DataFrame, gone: DataFrame) -> DataFrame:
    """(key, mark, keep, from, to): the runs of MIN_RUN words that an earlier document, keep, has outside of what is gone.

    ``plain`` has the texts (key, mark, text), ``stretches`` where they begin (key, mark, at, a, b, and the first words of
    their first and last lines), ``gone`` the paragraphs that go (key, mark, at, from, to). A stretch touches no
    other paragraph than those of its first and last line, since lines between are shorter than one.
    """
    left = shared_stretches(stretches)
    for line in ("line", "last_line"):
        left = left.join(gone.select("key", "mark", F.col("at").alias(line)), ["key", "mark", line], "left_anti")
    seeds = shared_stretches(stored(left.select("key", "mark", "at", "a", "b"))).groupBy("key", "mark").agg(F.collect_set("at").alias("seeds"))
    seeds = stored(seeds.join(gone.groupBy("key", "mark").agg(F.collect_list(F.struct("from", "to")).alias("gone")), ["key", "mark"], "left"))
    texts = fetched(plain, stored(seeds.select("key", "mark"))).join(seeds, ["key", "mark"]).select("key", "mark", "seeds", "gone", "text")
    with small_batches(plain.sparkSession):
        runs = stored(texts.mapInArrow(_runs, "key long, mark long, from long, to long, a long, b long"))
    keeps = runs.groupBy("a", "b").agg(F.min("key").alias("keep"), F.max("key").alias("last"), F.count(F.lit(1)).alias("n")).filter("keep < last").drop("last")
    return many_to_one(runs, stored(keeps), ["a", "b"], "n", ["key", "mark", "from"]).filter("key > keep").select("key", "mark", "keep", "from", "to")


def _paragraph_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, docs in _documents(batches, words):
            for d in docs:
                if d.count < MIN_WORDS:
                    continue
                a, b = d.paragraphs()
                b = b - words + 1
                low, high = _sums(d.shingles, a, b)
                sets = [np.unique(d.shingles[i:j]).view(np.int64) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
                ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["a", "b", "shingles"])

    return run


def candidate_pairs(classes: DataFrame) -> DataFrame:
    """Pairs a < b of nodes that share a band: each with the least of the band, and with neighbours.

    Only the neighbours within slots of about SLOT nodes are paired, so a band that very many
    paragraphs share is no larger task than any other. ``crowded`` says that the band has more
    nodes than are all paired that way; every node of such a band is in one of those pairs.
    """
    keys = classes.select("node", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("first")).filter("size > 1")
    placed = keys.join(shared, "band").withColumn("slot", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / SLOT)))
    order = Window.partitionBy("band", "slot").orderBy("node")
    near = placed.select("node", (F.col("size") > NEIGHBOURS + 2).alias("crowded"), F.array("first", *[F.lag("node", i).over(order) for i in range(1, NEIGHBOURS + 1)]).alias("others"))
    others = near.select("node", "crowded", F.explode("others").alias("other")).filter("other is not null and other <> node")
    return others.groupBy(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).agg(F.max("crowded").alias("crowded"))


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) by the confirmed pairs, and by all links between nodes of crowded bands that lie in different components."""
    joined = components(confirmed(pairs, sets, percent))
    crowded = stored(pairs.filter("crowded").select(F.explode(F.array("a", "b")).alias("rep")).distinct())
    if crowded.isEmpty():
        return joined
    of = joined.select(F.col("node").alias("rep"), "component")
    apart = sets.join(crowded, "rep", "left_semi").join(of, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    more = confirmed(crowded_pairs(apart, percent), sets, percent)
    return components(more.unionByName(joined.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def _paragraph_keeps(plain: DataFrame, paragraphs: DataFrame, percent: int, words: int) -> DataFrame:
    """(a, b, keep, n): the smallest doc_id of the component of each distinct paragraph, and how often it stands, stored."""
    grouped = paragraphs.groupBy("a", "b").agg(F.min(F.struct("key", "mark")).alias("first"), F.any_value("bands").alias("bands"), F.count(F.lit(1)).alias("n"))
    classes = stored(grouped.withColumn("node", F.monotonically_increasing_id()))
    pairs = stored(candidate_pairs(classes.select("node", "bands")))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = stored(classes.join(nodes, "node", "left_semi").select("node", "a", "b", "first.key", "first.mark"))
    texts = fetched(plain, stored(wanted.select("key", "mark").distinct()))
    sets = texts.mapInArrow(_paragraph_sets(words), "a long, b long, shingles array<long>")
    with small_batches(plain.sparkSession):
        sets = stored(sets.join(wanted.select("a", "b", F.col("node").alias("rep")), ["a", "b"]).select("rep", "shingles").dropDuplicates(["rep"]))
    joined = linked(pairs, sets, percent)
    placed = classes.select("a", "b", "n", F.col("first.key").alias("first"), "node").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    keeps = placed.groupBy("component").agg(F.min("first").alias("keep"), F.max("first").alias("last"), F.sum("n").alias("rows"))
    return stored(placed.join(keeps.filter("rows > 1").select("component", "keep"), "component").select("a", "b", "keep", "n"))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each (key, mark, pieces): the spans of its runs and paragraphs, those that touch merged."""
    for batch in batches:
        rows = []
        for x in batch.to_pylist():
            spans: list[list[int]] = []
            for p in sorted(x["pieces"], key=lambda p: (p["from"], p["to"])):
                if spans and p["from"] <= spans[-1][1] + 1:
                    spans[-1][1] = max(spans[-1][1], p["to"])
                else:
                    spans.append([p["from"], p["to"]])
            keeps = sorted({p["keep"] for p in x["pieces"]})
            rows.append({"doc_id": x["key"], "text_hash": x["mark"], "keep_ids": keeps, "spans": [{"from": a, "to": b} for a, b in spans], "removed_bytes": sum(b - a for a, b in spans)})
        span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("keep_ids", pa.list_(pa.int64())), ("spans", span), ("removed_bytes", pa.int64())]))


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, words: int = SHINGLE_WORDS) -> DataFrame:
    """What repeats from other documents: doc_id, text_hash, keep_ids, spans, removed_bytes; only documents that lose something.

    keep_ids are the earliest documents that have the removed pieces, spans the merged ranges to remove,
    in bytes of the UTF-8 text. Paragraphs of at least MIN_WORDS words go if they are like one of
    an earlier document; of what they leave, every run of at least MIN_RUN words goes that stands in an
    earlier document outside of paragraphs that go. Null
    and empty texts and shorter ones lose nothing, and what repeats within one document only
    stays. Rows with a null doc_id take no part. Rows that repeat a doc_id with other texts have
    spans of their own, told apart by text_hash, and lose nothing to one another; rows that repeat both
    are one document. Words are compared by hashes, A-Z as lower case. An empty table gives an
    empty result; other columns are ignored.
    """
    plain = marked(docs, doc_id, text).filter("key is not null")
    with small_batches(docs.sparkSession):
        pieces = stored(plain.mapInArrow(_pieces(words), "key long, mark long, at int, from long, to long, a long, b long, line int, last_line int, bands array<long>"))
    paragraphs = pieces.filter("bands is not null").drop("line", "last_line")
    alike = many_to_one(paragraphs.drop("bands"), _paragraph_keeps(plain, paragraphs, percent, words), ["a", "b"], "n", ["key", "mark", "from"])
    gone = stored(alike.filter("key > keep").select("key", "mark", "keep", "at", "from", "to"))
    stretches = pieces.filter("bands is null").drop("bands", "from", "to")
    found = repeated_runs(plain, stretches, gone).unionByName(gone.drop("at"))
    found = found.groupBy("key", "mark").agg(F.collect_list(F.struct("from", "to", "keep")).alias("pieces"))
    return found.mapInArrow(_merged, "doc_id long, text_hash long, keep_ids array<long>, spans array<struct<from:long,to:long>>, removed_bytes long")


def _without(text: str, spans: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.names.index(text)
            out = []
            for whole, gone in zip(batch.column(i).to_pylist(), batch.column(batch.schema.names.index(spans)).to_pylist(), strict=True):
                if not gone or whole is None:
                    out.append(whole)
                    continue
                data, at, left = whole.encode(), 0, []
                for span in gone:
                    left.append(data[at : span["from"]])
                    at = span["to"]
                out.append(b"".join([*left, data[at:]]).decode())
            yield batch.set_column(i, batch.schema.field(i), pa.array(out, pa.string()))

    return run


def drop_repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the repeated pieces of their texts, as ``repeated_passages`` finds them.

    All rows and columns stay, whatever the columns' names; blanks around a removed piece stay too. Rows
    with a null doc_id or text stay as they are, and rows that repeat a doc_id lose what their own texts repeat.
    """
    key, mark, spans = (fresh(docs, f"gone_{x}") for x in ("key", "mark", "spans"))
    gone = repeated_passages(docs, doc_id, text).select(F.col("doc_id").alias(key), F.col("text_hash").alias(mark), F.col("spans").alias(spans))
    joined = docs.join(gone, (docs[doc_id].cast("long") == F.col(key)) & (F.xxhash64(docs[text]) == F.col(mark)), "left").drop(key, mark)
    return joined.mapInArrow(_without(text, spans), joined.schema).drop(spans)
