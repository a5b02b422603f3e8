"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts of up to ORDER bytes, which start anew at each word.
A symbol is coded in the longest context that the tree has; where it hasn't followed there, an
escape is coded and the next shorter context tried, down to all 256 bytes alike. Escapes are
estimated by the number of distinct symbols seen (method C). The counts are frozen after
fitting, so a word has one exact code length under each language, and the text's shortest sum
names its language.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulewright.llm.wordscores import WordTable, held_out, scored_batches, words_of

ORDER = 4
#: Documents per language that are learned from at most, their first characters, and documents in all.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_ALL = 300, 50_000, 6000
UNDETERMINED = "und"
_MARKS = b".,;:!?*#%&$\"'()[]{}<>-_/\\|~`^+=@0123456789"


def _letters(word: bytes) -> bytes:
    """The word without marks and digits at its ends, or nothing if no letter is in it."""
    bare = word.strip(_MARKS)
    return bare if any(c.isalpha() for c in bare.decode("utf-8", "replace")) else b""


def _contexts(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each symbol of the words (each ends with a blank): ORDER+1 keys of it within its contexts.

    Row k of the keys is the symbol with the k bytes before it, and the place in the word tells
    which orders exist. Returns keys (ORDER + 1, n), place and the word's number of each symbol.
    """
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(np.int64) if words else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keys = np.zeros((ORDER + 1, len(data)), np.int64)
    keys[0] = data
    before = np.concatenate((np.full(ORDER, 32, np.int64), data))
    for k in range(1, ORDER + 1):
        # the byte k places back; before a word's first byte stands one blank, and no more
        back = np.where(place - k >= 0, before[ORDER - k : ORDER - k + len(data)], 32)
        keys[k] = keys[k - 1] | back << (8 * k)
    return keys, place, owner


@dataclass
class Model:
    """Frozen statistics: for each order sorted keys and their costs in bits by language."""

    langs: list[str]
    symbols: list[tuple[np.ndarray, np.ndarray]]
    escapes: list[tuple[np.ndarray, np.ndarray]]

    def bits(self, words: list[bytes]) -> np.ndarray:
        """Code length of each word under each language."""
        n = len(self.langs)
        if not words:
            return np.zeros((0, n), np.float32)
        keys, place, owner = _contexts(words)
        cost = np.zeros((keys.shape[1], n), np.float32)
        open_ = np.ones((keys.shape[1], n), bool)
        for k in range(ORDER, -1, -1):
            # a context longer than the word's beginning with its blank is no context
            rows = np.flatnonzero(open_.any(axis=1) & (place + 1 >= k))
            have, costs = self.symbols[k]
            at, hit = _find(have, keys[k, rows])
            found = np.where(hit[:, None], costs[at], np.nan) if len(have) else np.full((len(rows), n), np.nan)
            seen = ~np.isnan(found) & open_[rows]
            contexts, escape = self.escapes[k]
            at, hit = _find(contexts, keys[k, rows] >> 8)
            missed = np.where(hit[:, None], escape[at], 0.0) if len(contexts) else np.zeros((len(rows), n))
            still = open_[rows] & ~seen
            cost[rows] += np.where(seen, found, np.where(still, missed, 0.0)).astype(np.float32)
            open_[rows] = still
        cost += open_ * np.float32(8.0)
        return np.add.reduceat(cost, np.flatnonzero(place == 0), axis=0)

    def table(self) -> WordTable:
        def score(words: list[bytes]) -> np.ndarray:
            bare = [_letters(w) for w in words]
            out = np.zeros((len(words), len(self.langs) + 1), np.float32)
            known = [i for i, w in enumerate(bare) if w]
            if known:
                out[known, :-1] = self.bits([bare[i] for i in known])
                out[known, -1] = 1
            return out

        return WordTable(score)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def fit(texts: list[str], langs: list[str]) -> Model:
    """Counts contexts and symbols of each language and freezes them as code lengths."""
    names = sorted(set(langs))
    by_lang = []
    for name in names:
        words = [b for t, g in zip(texts, langs, strict=True) if g == name for w in words_of(t) if (b := _letters(w))]
        by_lang.append(_contexts(words))
    symbols, escapes = [], []
    for k in range(ORDER + 1):
        counted = [np.unique(keys[k, place + 1 >= k], return_counts=True) for keys, place, _ in by_lang]
        all_keys = np.unique(np.concatenate([c[0] for c in counted])) if counted else np.zeros(0, np.int64)
        all_contexts = np.unique(all_keys >> 8)
        cost = np.full((len(all_keys), len(names)), np.nan, np.float32)
        leave = np.zeros((len(all_contexts), len(names)), np.float32)
        for g, (keys, counts) in enumerate(counted):
            contexts, inverse, kinds = np.unique(keys >> 8, return_inverse=True, return_counts=True)
            total = np.bincount(inverse, weights=counts, minlength=len(contexts))
            cost[np.searchsorted(all_keys, keys), g] = -np.log2(counts / (total + kinds)[inverse])
            leave[np.searchsorted(all_contexts, contexts), g] = -np.log2(kinds / (total + kinds))
        symbols.append((all_keys, cost))
        escapes.append((all_contexts, leave))
    return Model(names, symbols, escapes)


def sample(docs: DataFrame, doc_id: str, text: str, lang: str, per_lang: int = SAMPLE_DOCS, seed: int = 13) -> DataFrame:
    """Rows (key, lang, text) to learn from, outside the held-out fold: the least hashes of each language.

    At most SAMPLE_ALL texts, and of each its first SAMPLE_CHARS characters.
    """
    rows = docs.select(F.col(doc_id).alias("key"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.filter(F.col("key").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("key")))
    order = Window.partitionBy("lang").orderBy("order", "key", "hash")
    least = rows.select("key", "hash", "lang", F.xxhash64(F.lit(seed), "key").alias("order")).withColumn("rank", F.row_number().over(order))
    chosen = least.filter(F.col("rank") <= per_lang).orderBy("rank", "lang").limit(SAMPLE_ALL).select("key", "hash", "lang").distinct()
    found = rows.join(F.broadcast(chosen), ["key", "hash", "lang"]).select("key", "hash", "lang", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    return found.dropDuplicates(["key", "hash", "lang"])


def _learned(docs: DataFrame, doc_id: str, text: str, lang: str) -> Model:
    """The model, fitted in one task on the bounded sample; only its frozen statistics come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((x["key"], x["hash"], x["lang"], x["text"]) for batch in batches for x in batch.to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([r[3] for r in rows], [r[2] for r in rows]))], pa.binary())], names=["model"])

    found = sample(docs, doc_id, text, lang).repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found["model"]) if found else fit([], [])


def predict(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Language of every row's whole text: doc_id, held_out, lang_pred, score (0 to 1).

    Learns from a bounded sample of rows with a language outside the held-out fold. The score is
    the posterior of the language, all alike before, from the code lengths. A null text and one
    without letters has ``und`` and score 0, and so has every text if there is nothing to learn
    from. Equal lengths go to the first name. Other columns are ignored; rows that repeat stay.
    """
    model = _learned(docs, doc_id, text, lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        names = np.array([*model.langs, UNDETERMINED], object)
        n = len(model.langs)
        for batch, words, counts in scored_batches(batches):
            sums = np.zeros((len(counts), n + 1))
            some = np.flatnonzero(counts)
            if len(some):
                sums[some] = np.add.reduceat(table.lookup(words), (np.cumsum(counts) - counts)[some], axis=0, dtype=np.float64)
            lengths, known = sums[:, :-1], sums[:, -1] > 0
            if n:
                best = np.where(known, lengths.argmin(axis=1), n)
                posterior = np.exp2(lengths.min(axis=1, keepdims=True) - lengths)
                score = np.where(known, 1 / posterior.sum(axis=1), 0.0)
            else:
                best, score = np.zeros(len(counts), np.int64), np.zeros(len(counts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names[best], pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).alias("key"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return rows.select(F.col("key").cast("long").alias("key"), "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
