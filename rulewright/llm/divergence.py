"""Divergence audit of sources: how far each (lang, source) group's term probabilities lie from its peers' and its language's.

Terms are counted where the texts are, partial counts are summed by (lang, term, source), and a
language keeps the terms that enough of its documents have. The kept terms of a language are dealt into
segments, and its sources to seats; a block is what the sources of one seat have in one segment.
Distances are sums over terms, so each segment holds a tournament of its own: blocks stay in the
partition of their seat, while compressed copies of the peers' vectors go round. In each round of the
tournament every seat meets one other (the circle method), and a meeting gives both directions at
once. The terms of a group that stand out of its language are ranked by a heap of each block, and the
heaps' best are ranked once more.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulewright.llm.common import slices, stored, text_column

#: Documents of a language that a kept term has at least; what is added to each count; the scale of probabilities; ranks of the part ``term``.
MIN_DOCS, PSEUDO, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Seats of a language at most (so many rounds, less one, are played) and entries of a block, in sources times terms, about.
SEATS, CELLS = 64, 4096
#: Rounds that one job plays; the vectors that travel in them lie in its shuffle.
ROUNDS = 24
#: Distinct terms that a task holds before it hands its counts on, and bytes of a text that are taken apart at a time.
HELD, PIECE = 300_000, 4 << 20

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"


def _terms(text: bytes) -> list[bytes]:
    """The terms of a text: runs of letters A-Z, made small, and of characters beyond ASCII."""
    return text.translate(_LETTERS).split()


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces that are cut at blanks, in which no term lies."""
    at = 0
    while len(text) - at > PIECE:
        cut = text.find(b" ", at + PIECE)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each group's terms, and of the documents that have them, for a bounded number of terms at a time."""
    counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
    docs: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in counts.items():
            n = len(found)
            of = docs[lang, source]
            columns = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64()), pa.array([of[t] for t in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        counts.clear()
        docs.clear()

    for batch in slices(batches, "text"):
        data, offsets = text_column(batch, "text")
        for i, (lang, source) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)):
            text = data[offsets[i] : offsets[i + 1]].tobytes()
            mine, own = counts[lang, source], docs[lang, source]
            if len(text) <= PIECE:
                terms = _terms(text)
                mine.update(terms)
                own.update(set(terms))
            else:
                seen: set[bytes] = set()
                for piece in _pieces(text):
                    terms = _terms(piece)
                    mine.update(terms)
                    seen.update(terms)
                own.update(seen)
        if sum(map(len, counts.values())) > HELD:
            yield from flushed()
    yield from flushed()


def _probability(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + PSEUDO) / (total + PSEUDO * terms)) of long columns, in exact decimals."""
    return F.expr(f"1 + (cast({count} + {PSEUDO} AS decimal(20,0)) * {SCALE}) div cast({total} + {PSEUDO} * {terms} AS decimal(20,0))")


_BLOCK = "lang string, segment int, seat int, seats int, width int, sources array<string>, data binary, tops array<struct<source: string, term: string, value: long>>"


def _packed(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> bytes:
    """The sparse vectors of a block, compressed: (p of absent terms, places, p of present terms) of each source."""
    parts = [np.array([len(rows)], np.int64), np.array([len(at) for _, at, _ in rows], np.int64), np.array([base for base, _, _ in rows], np.int64)]
    for _, at, p in rows:
        parts += [np.diff(at, prepend=0), p]
    return zlib.compress(np.concatenate(parts).astype(np.int64).tobytes(), 1)


def _unpacked(data: bytes, width: int) -> np.ndarray:
    """The block as a matrix, a row for each source and a column for each of the ``width`` terms."""
    flat = np.frombuffer(zlib.decompress(data), np.int64)
    n = int(flat[0])
    out = np.repeat(flat[1 + n : 1 + 2 * n][:, None], width, axis=1)
    at = 1 + 2 * n
    for i, size in enumerate(flat[1 : 1 + n].tolist()):
        out[i, np.cumsum(flat[at : at + size])] = flat[at + size : at + 2 * size]
        at += 2 * size
    return out


def _block(part: pa.Table) -> pa.Table:
    """One seat's sources in one segment, with the best TOP terms of each by a heap; the rows without a term bring p of absent ones."""
    lang, segment, seat, seats, width = (part.column(c)[0].as_py() for c in ("lang", "segment", "seat", "seats", "width"))
    found: dict[str, tuple[int, list, list]] = {}
    by = part.select(["source", "place", "term", "p", "q"]).sort_by([("source", "ascending"), ("place", "ascending")])
    sources = by.column("source").to_pylist()
    places, terms, p, q = (by.column(c).to_pylist() for c in ("place", "term", "p", "q"))
    for source, place, x in zip(sources, places, p, strict=True):
        if place is None:
            found[source] = (x, [], [])
    excess: dict[str, list[tuple[int, bytes]]] = defaultdict(list)
    for source, place, term, x, y in zip(sources, places, terms, p, q, strict=True):
        if place is not None:
            found[source][1].append(place)
            found[source][2].append(x)
            if x > y:
                excess[source].append((y - x, term.encode()))
    heaps = {source: heapq.nsmallest(TOP, pairs) for source, pairs in excess.items()}
    order = sorted(found)
    data = _packed([(found[s][0], np.array(found[s][1], np.int64), np.array(found[s][2], np.int64)) for s in order])
    tops = [{"source": s, "term": t.decode(), "value": -v} for s, best in heaps.items() for v, t in best]
    return pa.Table.from_pylist([{"lang": lang, "segment": segment, "seat": seat, "seats": seats, "width": width, "sources": order, "data": data, "tops": tops}], _BLOCK_SCHEMA)


_BLOCK_SCHEMA = pa.schema([
    ("lang", pa.string()), ("segment", pa.int32()), ("seat", pa.int32()), ("seats", pa.int32()), ("width", pa.int32()), ("sources", pa.list_(pa.string())), ("data", pa.binary()),
    ("tops", pa.list_(pa.struct([("source", pa.string()), ("term", pa.string()), ("value", pa.int64())]))),
])
_MET = "lang string, source string, item string, value long"


def _met(lang: str, ours: list[str], theirs: list[str], distances: np.ndarray) -> pa.RecordBatch:
    """Both directions of a meeting."""
    a, b = [x for x in ours for _ in theirs], theirs * len(ours)
    values = distances.ravel().tolist() * 2
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(a + b, pa.string()), pa.array(b + a, pa.string()), pa.array(values, pa.int64())], names=["lang", "source", "item", "value"])


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each resident block against the peer that has come to it; without a peer, its sources among themselves."""
    for batch in batches:
        for i in range(batch.num_rows):
            x = batch.slice(i, 1).to_pylist()[0]
            lang, ours, block = x["lang"], x["sources"], _unpacked(x["data"], x["width"])
            if x["peer_data"] is not None:
                peer = _unpacked(x["peer_data"], x["width"])
                yield _met(lang, ours, x["peer_sources"], np.stack([np.abs(peer - row).sum(axis=1) for row in block]))
            else:
                for k in range(len(block) - 1):
                    yield _met(lang, ours[k : k + 1], ours[k + 1 :], np.abs(block[k + 1 :] - block[k]).sum(axis=1)[None, :])


def _opponent() -> Column:
    """Whom a seat meets in round ``turn``: two seats below the last meet when they add up to the round's number, and the last meets the one left over."""
    n, seat, turn = F.col("seats"), F.col("seat"), F.col("turn")
    other = F.pmod(turn - seat, n - 1)
    return F.when(seat == n - 1, F.pmod(turn * F.floor(n / 2), n - 1)).when(other == seat, n - 1).otherwise(other).cast("int")


def _groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """A row for each occurring (lang, source): seat, seats, segments, terms (V), total (N), lang_total."""
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total"))
    groups = docs.select("lang", "source").distinct()
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    # a row for each source of a language: the result has that many rows squared
    seated = groups.withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    seats = F.least(F.lit(SEATS), F.col("sources") + F.col("sources") % 2)
    out = seated.join(sizes, "lang").join(of_lang, "lang", "left").join(totals, ["lang", "source"], "left")
    out = out.select("lang", "source", "sources", (F.col("number") % seats).cast("int").alias("seat"), seats.cast("int").alias("seats"), zero("terms"), zero("total"), zero("lang_total"))
    cells = F.col("terms") * F.ceil(F.col("sources") / F.col("seats"))
    return out.withColumn("segments", F.greatest(F.lit(1), F.ceil(cells / CELLS)).cast("int"))


def _blocks(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """One row for each (lang, segment, seat), with empty vectors for groups that have no term there."""
    shape = groups.select("lang", "segments", "terms", "lang_total").distinct()
    segment = F.pmod(F.xxhash64("term"), F.col("segments")).cast("int")
    # places within a segment: its rows are about CELLS, times the seats
    placed = kept.join(shape, "lang").withColumn("segment", segment)
    place = F.dense_rank().over(Window.partitionBy("lang", "segment").orderBy("term")) - 1
    q = _probability("lang_n", "lang_total", "terms")
    placed = placed.select("lang", "segment", "source", "term", "n", place.alias("place"), q.alias("q"))
    widths = placed.groupBy("lang", "segment").agg((F.max("place") + 1).cast("int").alias("width"))
    seats = groups.select("lang", "source", "seat", "seats", "terms", "total", "segments")
    columns = ["lang", "segment", "source", "seat", "seats", "place", "term", "p", "q"]
    own = placed.join(seats, ["lang", "source"]).withColumn("p", _probability("n", "total", "terms")).select(*columns)
    none = F.when(F.col("total") + F.col("terms") > 0, _probability("0", "total", "greatest(terms, 1)")).otherwise(1)
    absent = seats.withColumn("segment", F.explode(F.sequence(F.lit(0), F.col("segments") - 1))).select("lang", "segment", "source", "seat", "seats", F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("term"), none.alias("p"), F.lit(None).cast("long").alias("q"))
    rows = own.unionByName(absent).join(widths, ["lang", "segment"], "left").withColumn("width", F.coalesce("width", F.lit(0)))
    return rows.groupBy("lang", "segment", "seat").applyInArrow(_block, _BLOCK)


def _tournament(blocks: DataFrame, rounds: int) -> DataFrame:
    """Distances (lang, source, item, value), summed over all meetings: at home, and in ``rounds`` rounds."""
    key = ["lang", "segment", "seat"]
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    residents = blocks.select(*key, "width", "sources", "data").repartition(tasks, *key).persist(StorageLevel.MEMORY_AND_DISK)
    none = (F.lit(None).cast("array<string>").alias("peer_sources"), F.lit(None).cast("binary").alias("peer_data"))
    played = [blocks.filter(F.size("sources") > 1).select("lang", "width", "sources", "data", *none)]
    for first in range(0, rounds, ROUNDS):
        turns = F.sequence(F.lit(first), F.least(F.lit(first + ROUNDS), F.col("seats") - 1) - 1)
        peers = blocks.filter(F.col("seats") - 1 > first).withColumn("turn", F.explode(turns)).withColumn("meets", _opponent()).filter("meets < seat")
        peers = peers.select("lang", "segment", F.col("meets").alias("seat"), F.col("sources").alias("peer_sources"), F.col("data").alias("peer_data"))
        played.append(residents.join(peers, key).select(*played[0].columns))
    sums = [stored(met.mapInArrow(_meetings, _MET).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))) for met in played]
    residents.unpersist()
    return reduce(DataFrame.unionByName, sums).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """How far each source's terms lie from its peers' and its language's: lang, source, part, item, value, rank.

    A null text, language or source counts as ''. Terms are runs of letters A-Z, made small, and of
    characters beyond ASCII. A language keeps the V terms that at least ``min_docs`` of its
    documents have. A group of counts n with sum N over kept terms gives each kept term
    p = 1 + floor(10^9 * (n + 5) / (N + 5 V)), and so does the language as a whole.

    Part ``pair``: for each other source of the language the sum of absolute differences of p over all
    kept terms, all ranks. Part ``term``: the kept terms that the group has with a larger p than its
    language, by difference, up to rank 50. Ranks count from 1, largest value first, ties by the
    item's UTF-8. Documents count by row, so repeated rows count again; other columns are ignored.
    A language without kept terms has pairs of value 0, one with a single source has none; an
    empty table gives an empty result. Texts of any length are counted whole. Counts of a
    language fit the arithmetic up to 10^19.
    """
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    # one shuffle, by term: the sums over all sources of a term then need no other
    counts = rows.mapInArrow(_partial_counts, _COUNTS).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    summed = counts.select("lang", "term", "source", "n", F.sum("docs").over(of_term).alias("docs"), F.sum("n").over(of_term).alias("lang_n"))
    kept = stored(summed.filter(F.col("docs") >= min_docs).drop("docs"))
    groups = stored(_groups(rows, kept))
    rounds = (groups.agg(F.max("seats")).first()[0] or 1) - 1
    blocks = stored(_blocks(kept, groups))
    pairs = _tournament(blocks, rounds).withColumn("part", F.lit("pair"))
    tops = blocks.select("lang", F.explode("tops").alias("t")).select("lang", "t.source", F.col("t.term").alias("item"), "t.value", F.lit("term").alias("part"))
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(by)).unionByName(tops.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= TOP))
    return ranked.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
