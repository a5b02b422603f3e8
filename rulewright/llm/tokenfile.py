"""Token-id files: id arrays of many documents, with Elias-Fano coded document boundaries.

A file is a Parquet table of segments in document order. A segment holds the ids of its
documents one behind the other, as 16-bit numbers where the vocabulary allows and 32-bit ones
else, and two Elias-Fano sequences: the documents' end offsets and their ids. A select
structure (the place of each 256th set bit) finds an offset without a table of offsets.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.llm.common import run_dir, slices
from rulewright.llm.mixing import running_start

END_ID = 0
SEGMENT_IDS = 1 << 19
#: Words of the present and of the last generation, each, whose ids a Python worker remembers at most.
CACHE_WORDS = 700_000
SELECT_EVERY = 256
_SEGMENT = "shard int, segment int, docs long, nulls long, ids long, width int, first_id long, last_id long, data binary, ends_low binary, ends_high binary, ends_select binary, keys_low binary, keys_high binary, keys_select binary"


class EliasFano:
    """A non-decreasing sequence of numbers from 0 to ``top`` in about 2 + log2(top / n) bits each."""

    def __init__(self, n: int, top: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.top, self.low, self.high, self.samples = n, top, low, high, samples
        self.width = self.low_bits(n, top)

    @staticmethod
    def low_bits(n: int, top: int) -> int:
        return max(0, int(math.log2(top / n))) if n and top > n else 0

    @classmethod
    def encode(cls, values: np.ndarray, top: int) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        width = cls.low_bits(n, top)
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        lows = ((values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        pack = lambda b: np.packbits(b, bitorder="little").tobytes()
        return cls(n, top, pack(lows.reshape(-1)), pack(bits), ones[::SELECT_EVERY].astype("<u4").tobytes())

    def _low(self, start: int, count: int) -> np.ndarray:
        if not self.width:
            return np.zeros(count, np.int64)
        first = start * self.width
        raw = np.frombuffer(self.low, np.uint8)[first // 8 : (first + count * self.width + 7) // 8]
        bits = np.unpackbits(raw, bitorder="little")[first % 8 :][: count * self.width].reshape(count, self.width)
        return bits.astype(np.int64) @ (np.int64(1) << np.arange(self.width, dtype=np.int64))

    def select(self, i: int) -> int:
        """Value number ``i``: from the last sample before it, only that stretch of bits is read."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(np.frombuffer(self.samples, "<u4")[i // SELECT_EVERY])
        left, byte = i % SELECT_EVERY, at // 8
        while True:
            bits = np.unpackbits(np.frombuffer(self.high, np.uint8)[byte : byte + 64], bitorder="little")
            ones = np.flatnonzero(bits)
            ones = ones[ones + 8 * byte >= at]
            if left < len(ones):
                return ((8 * byte + int(ones[left]) - i) << self.width) | int(self._low(i, 1)[0])
            left, byte, at = left - len(ones), byte + 64, 8 * (byte + 64)

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        return ((ones - np.arange(self.n)) << self.width) | self._low(0, self.n)


@lru_cache(maxsize=2)
def _encoder(path: str):
    return WordEncoder(path)


class WordEncoder:
    """Encodes texts with a byte-level BPE file of the tokenizers library, remembering words.

    The file's splitting rule always starts a new piece at a space between two other characters
    that aren't white space, so a text's ids are those of its words, each with its space before it.
    """

    _blanks = re.compile(r"\s(?:\s|\Z)")
    _cuts = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        if self.tok.normalizer is not None or "ByteLevel" not in repr(self.tok.pre_tokenizer):
            raise ValueError(f"{path}: not a byte-level tokenizer without normaliser")
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if max(vocab.values()) < 1 << 16 else np.dtype("<u4")
        self.starts = np.zeros(max(vocab.values()) + 1, bool)
        self.starts[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self.seen: dict[str, bytes] = {}
        self.last: dict[str, bytes] = {}
        self.firsts: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype).tobytes()

    def _first(self, word: str) -> bytes:
        """The ids of a text's first word, which has no space before it."""
        if word not in self.firsts:
            if len(self.firsts) > CACHE_WORDS:
                self.firsts.clear()
            self.firsts[word] = self.whole(word)
        return self.firsts[word]

    def _learn(self, words: list[str]) -> None:
        """Ids of words without blanks at their ends or spaces within, many at a time."""
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        at = 0
        while at < len(words):
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 200_000, "right"))
            run = words[at : max(at + 1, upto)]
            at += len(run)
            ids = np.array(self.tok.encode_batch_fast([" " + " ".join(run)], add_special_tokens=False)[0].ids, self.dtype)
            heads = np.flatnonzero(self.starts[ids])
            if len(heads) != len(run):
                raise ValueError("the tokenizer doesn't split at single spaces")
            data, w = ids.tobytes(), self.dtype.itemsize
            edges = [*(heads * w).tolist(), len(data)]
            self.seen.update(zip(run, (data[a:b] for a, b in zip(edges, edges[1:], strict=False)), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts, as little-endian numbers of ``dtype``."""
        parts: list[tuple[bytes, list[str]]] = []
        new: set[str] = set()
        for text in texts:
            if any(s in text for s in self.special):
                parts.append((self.whole(text), []))
                continue
            words = self._cuts.split(text) if text[:1].isspace() or self._blanks.search(text) else text.split(" ")
            first = words.pop(0)
            new.update(words)
            parts.append((self._first(first) if first else b"", words))
        if len(self.seen) > CACHE_WORDS:
            self.seen, self.last = {}, self.seen
        new -= self.seen.keys()
        again = new & self.last.keys()
        self.seen.update((w, self.last[w]) for w in again)
        new -= again
        odd = [w for w in new if " " in w]
        self.seen.update((w, self.whole(" " + w)) for w in odd)
        self._learn(list(new.difference(odd)))
        get = self.seen.__getitem__
        return [first + b"".join(map(get, words)) for first, words in parts]


def _segments(path: str, end_id: int, segment_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = _encoder(path), TaskContext.get().partitionId()
        end = np.array([end_id], coder.dtype).tobytes()
        schema = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), *((c, pa.int64()) for c in ("docs", "nulls", "ids")), ("width", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()),
                            *((c, pa.binary()) for c in ("data", "ends_low", "ends_high", "ends_select", "keys_low", "keys_high", "keys_select"))])
        keys: list[int | None] = []
        held: list[bytes] = []
        number = size = 0

        def segment() -> pa.RecordBatch:
            ends = np.cumsum([len(x) // coder.dtype.itemsize for x in held])
            known = np.array([k for k in keys if k is not None], np.int64)
            first = int(known[0]) if len(known) else 0
            a = EliasFano.encode(ends, int(ends[-1]))
            last = int(known[-1]) if len(known) else 0
            b = EliasFano.encode((known - first).astype(np.uint64), last - first)
            row = [shard, number, len(keys), len(keys) - len(known), int(ends[-1]), coder.dtype.itemsize, first, last, b"".join(held), a.low, a.high, a.samples, b.low, b.high, b.samples]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in slices(batches, "text", 2 << 20, 2000):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            for key, ids in zip(batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), coder.encode(texts), strict=True):
                keys.append(key)
                held.append(ids + end)
                size += len(ids) // coder.dtype.itemsize + 1
                if size >= segment_ids:
                    yield segment()
                    keys, held, size, number = [], [], 0, number + 1
        if keys:
            yield segment()

    return run


def _bounds_below(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are less than ``key``, by binary search."""
    bits = len(bounds).bit_length()
    full = F.array(*[F.lit(b) for b in bounds + [(1 << 63) - 1] * ((1 << bits) - 1 - len(bounds))]).cast("array<bigint>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(bits))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(full, at + step - 1) < key, at + step).otherwise(at))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> None:
    """Writes the ids of all texts to ``path``, in ascending doc_id order (null first), ``end_id`` after each.

    Null counts as an empty text, which has the end id alone. Rows that repeat a doc_id all
    stand, in the order of their texts' hashes. An empty table gives a file without segments.
    ``tokenizer`` is the path of a byte-level tokenizer file on every executor.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # ranges by the quantiles of the ids alone: a range partitioning of the rows would read all texts once more
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(rows.select("doc_id").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    part = _bounds_below(F.col("doc_id"), [int(b) for b in bounds]) if bounds else F.lit(0)
    rows = rows.repartitionById(parts, F.when(F.col("doc_id").isNull(), 0).otherwise(part)).sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows.mapInArrow(_segments(tokenizer, end_id, segment_ids), _SEGMENT).write.option("compression", "zstd").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.to_pylist():
            known = x["docs"] - x["nulls"]
            ends = EliasFano(x["docs"], x["ids"], x["ends_low"], x["ends_high"], x["ends_select"]).values()
            keys = EliasFano(known, x["last_id"] - x["first_id"], x["keys_low"], x["keys_high"], x["keys_select"])
            starts = np.concatenate(([0], ends[:-1]))
            data = np.frombuffer(x["data"], f"<u{x['width']}").astype("<u4")
            crcs = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = x["docs"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x["shard"]] * n, pa.int32()), pa.array([x["segment"]] * n, pa.int32()), pa.array([None] * x["nulls"] + (keys.values() + x["first_id"]).tolist(), pa.int64()),
                 pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crcs, pa.int64())],
                names=["shard", "segment", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Each document of a token file: doc_id, start (ids of all before it), n_tokens, ids_crc32."""
    file = spark.read.parquet(path)
    bases = running_start(file.select(F.lit(0).alias("all"), "shard", "segment", "ids"), "all", "shard", [F.col("segment")], "ids", "base").select("shard", "segment", "base")
    rows = file.mapInArrow(_documents, "shard int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(bases, ["shard", "segment"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def tokens_of(file: DataFrame) -> DataFrame:
    """The ids themselves: (doc_id, ids) for each document of a token file's table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                found = next(_documents(iter([pa.RecordBatch.from_pylist([x], schema=batch.schema)])))
                data = np.frombuffer(x["data"], f"<u{x['width']}").astype(np.int32)
                ends = np.concatenate(([0], EliasFano(x["docs"], x["ids"], x["ends_low"], x["ends_high"], x["ends_select"]).values())).astype(np.int32)
                yield pa.RecordBatch.from_arrays([found.column(2), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(data, pa.int32()))], names=["doc_id", "ids"])

    return file.mapInArrow(run, "doc_id long, ids array<int>")


def token_file(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes ``docs`` to a token file in the shared folder and returns what is read back from it."""
    import uuid

    spark = docs.sparkSession
    path = f"{run_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, doc_id, text)
    return read_tokens(spark, path)
