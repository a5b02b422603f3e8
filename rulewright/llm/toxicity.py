"""Toxicity from subword bags: embeddings averaged into a linear softmax, trained in numpy.

A word's bag holds the hashes of the word and of its character n-grams (in UTF-8 bytes, with
marks for both ends), so that an unseen misspelling shares most of them with a known word. The
embeddings are averaged over each run of a few words, and a linear softmax tells toxic runs from
clean ones. A document is as toxic as its most toxic run, so that length dilutes nothing; in
training a clean document's runs are all clean, and a toxic document's top run is toxic.

Texts without blanks are long words: a word of more than PART bytes is taken apart into
overlapping parts, each of which counts as a word of the run, so that no byte of it is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulewright.llm.common import mix64
from rulewright.llm.wordscores import WordTable, held_out, scored_batches, words_of

#: The documents of each class that the classifier is fitted on, at most, and the characters of one of them and of a class.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS, CLASS_CHARS = 1500, 2500, 200_000, 16_000_000
BUCKETS, DIM, RUN, STEPS = 1 << 17, 8, 4, 120
_GRAMS = (3, 4, 5, 6)
#: The longest word that is scored as one, in bytes, and the bytes that parts of longer ones share (more than an n-gram's).
PART, OVERLAP = 64, 8
_EDGE = b".,;:!?*#%&$\"'()[]{}<>-_/\\|~`^+=@"


def parted(words: list[bytes], counts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The words with those of more than PART bytes taken apart, and each document's number of them."""
    out, sizes = [], np.ones(len(words), np.int64)
    for i, word in enumerate(words):
        if len(word) <= PART or len(bare := word.strip(_EDGE) or word) <= PART:
            out.append(word)
            continue
        parts = [bare[at : at + PART] for at in range(0, len(bare) - OVERLAP, PART - OVERLAP)]
        out.extend(parts)
        sizes[i] = len(parts)
    before, ends = np.concatenate(([0], np.cumsum(sizes))), np.cumsum(counts)
    return out, before[ends] - before[ends - counts]


def bags(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' bags, one behind the other, and where each bag starts."""
    marked = [b"<" + (w.strip(_EDGE) or w) + b">" for w in words]
    sizes = np.array([len(w) for w in marked], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    found, of = [], []
    with np.errstate(over="ignore"):
        code = np.zeros(len(data), np.uint64)
        for n in range(1, max(_GRAMS) + 1):
            code = code[: max(0, len(data) - n + 1)] * np.uint64(0x100000001B3) + (data[n - 1 :] + np.uint64(1))
            if n in _GRAMS:
                inside = np.flatnonzero(np.arange(len(code)) + n <= ends[owner[: len(code)]])
                found.append(mix64(code[inside] + np.uint64(n)))
                of.append(owner[inside])
        whole = np.array([hash_bytes(w) for w in marked], np.uint64)
    found.append(mix64(whole))
    of.append(np.arange(len(words)))
    of, found = np.concatenate(of), np.concatenate(found)
    order = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[order], np.arange(len(words)))
    return (found[order] % np.uint64(BUCKETS)).astype(np.int64), starts


def hash_bytes(word: bytes) -> int:
    import zlib

    return zlib.crc32(word) | zlib.adler32(word) << 32


@dataclass
class Model:
    """Weight of each bucket in the toxic logit, and the bias."""

    weights: np.ndarray
    bias: float

    def table(self) -> WordTable:
        def score(words: list[bytes]) -> np.ndarray:
            if not words:
                return np.zeros((0, 1), np.float32)
            grams, starts = bags(words)
            counts = np.diff(np.append(starts, len(grams)))
            return (np.add.reduceat(self.weights[grams], starts) / counts).astype(np.float32)[:, None]

        return WordTable(score)

    def scores(self, table: WordTable, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        words, counts = parted(words, counts)
        values = table.lookup(words)[:, 0].astype(np.float64)
        top, _ = top_runs(values, counts)
        return 1 / (1 + np.exp(-np.clip(self.bias + top, -60, 60)))


def top_runs(values: np.ndarray, counts: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Highest mean over ``run`` consecutive words of each document, and the word where it starts.

    A document with fewer words is averaged over all its words; without words the mean is 0.
    """
    ends = np.cumsum(counts)
    starts = ends - counts
    sums = np.concatenate(([0.0], np.cumsum(values)))
    top, at = np.zeros(len(counts)), starts.copy()
    short = np.flatnonzero((counts > 0) & (counts <= run))
    top[short] = (sums[ends[short]] - sums[starts[short]]) / counts[short]
    long = np.flatnonzero(counts > run)
    if len(long):
        means = (sums[run:] - sums[:-run]) / run
        # runs that cross into the next document don't count
        cross = np.ones(len(values), bool)
        for i in range(run - 1):
            cross[np.maximum(ends[counts > 0] - 1 - i, 0)] = False
        means = np.where(cross[: len(means)], means, -np.inf)
        means = np.append(means, np.full(len(values) - len(means), -np.inf))
        best = np.maximum.reduceat(means, starts[long]) if len(long) == len(counts) else np.array([means[a:b].max() for a, b in zip(starts[long], ends[long], strict=True)])
        top[long] = best
        at[long] = [starts[d] + int(np.argmax(means[starts[d] : ends[d]])) for d in long]
    return top, at


def _all_bags(words: list[bytes], at_once: int = 20_000) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets, starts and sizes of the words' bags, a few words at a time."""
    out = []
    for at in range(0, len(words), at_once):
        grams, starts = bags(words[at : at + at_once])
        out.append((grams.astype(np.int32), starts, np.diff(np.append(starts, len(grams)))))
    return out


def fit(texts: list[str], toxic: np.ndarray, steps: int = STEPS, seed: int = 5) -> Model:
    """Trains embeddings and softmax jointly by Adam, first on whole documents, then on their top runs."""
    rng = np.random.default_rng(seed)
    vocabulary: dict[bytes, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in parted(words_of(t), np.zeros(0, np.int64))[0]], np.int32) for t in texts]
    keep = [i for i, d in enumerate(docs) if len(d)]
    docs, toxic = [docs[i] for i in keep], toxic[keep].astype(np.float64)
    if not len(docs) or toxic.min() == toxic.max():
        rate = (toxic.sum() + 0.5) / (len(toxic) + 1) if len(docs) else 0.25
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(rate / (1 - rate))))
    counts = np.array([len(d) for d in docs])
    tokens = np.concatenate(docs)
    parts = _all_bags(list(vocabulary))
    firsts = np.cumsum([0, *[len(sizes) for *_, sizes in parts]])
    E = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    U = rng.normal(0, 1, DIM).astype(np.float32)
    bias, state, heads = -1.0, {}, np.cumsum(counts) - counts
    weight = np.where(toxic == 1, 0.5 / toxic.sum(), 0.5 / (1 - toxic).sum())

    def adam(name: str, value: np.ndarray, grad: np.ndarray, rate: float, step: int) -> np.ndarray:
        m, v = state.get(name, (0.0, 0.0))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        state[name] = (m, v)
        return value - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)

    doc_of = np.repeat(np.arange(len(docs), dtype=np.int32), counts)
    for step in range(1, steps + 1):
        scalar = (E @ U).astype(np.float32)
        word = np.concatenate([np.add.reduceat(scalar[grams], starts) / sizes for grams, starts, sizes in parts])
        values = word[tokens].astype(np.float64)
        if step <= steps // 3:
            logits = bias + np.add.reduceat(values, heads) / counts * 20
            share = np.bincount(tokens, weights=((1 / (1 + np.exp(-logits)) - toxic) * weight / counts * 20)[doc_of], minlength=len(vocabulary))
        else:
            top, at = top_runs(values, counts)
            logits = bias + top
            error = (1 / (1 + np.exp(-np.clip(logits, -60, 60))) - toxic) * weight
            length = np.minimum(counts, RUN)
            picked = np.concatenate([np.arange(a, a + n) for a, n in zip(at, length, strict=True)])
            share = np.bincount(tokens[picked], weights=np.repeat(error / length, length), minlength=len(vocabulary))
        error = (1 / (1 + np.exp(-np.clip(logits, -60, 60))) - toxic) * weight
        bucket = np.zeros(BUCKETS)
        for (grams, _, sizes), at in zip(parts, firsts, strict=False):
            bucket += np.bincount(grams, weights=np.repeat(share[at : at + len(sizes)] / sizes, sizes), minlength=BUCKETS)
        bucket = bucket.astype(np.float32)
        touched = np.flatnonzero(bucket)
        grad_u = bucket[touched] @ E[touched]
        E = adam("E", E, bucket[:, None] * U[None, :], 0.05, step)
        U = adam("U", U, grad_u, 0.02, step)
        bias = float(adam("b", np.float64(bias), np.float64(error.sum()), 0.05, step))
    return Model((E @ U).astype(np.float32), bias)


def sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, toxic: int, clean: int, seed: int = 11) -> DataFrame:
    """Rows (key, mark, text) to learn from, outside the held-out fold: of each class those with the least hashes.

    At most ``toxic`` + ``clean`` documents that ``docs`` has, and of a class none behind the one with
    which it comes to CLASS_CHARS characters. Longer texts than SAMPLE_CHARS are taken after all others,
    and by their first SAMPLE_CHARS characters. Of rows that repeat a doc_id the shortest counts.
    """
    marks = labels.select(F.col(doc_id).cast("long").alias("key"), F.col("toxic").alias("mark")).filter(F.col("mark").isNotNull() & F.col("key").isNotNull())
    marks = marks.filter(~held_out(F.col("key"))).groupBy("key").agg(F.max(F.when(F.col("mark") == 1, 1).otherwise(0)).alias("mark"))
    rows = docs.select(F.col(doc_id).cast("long").alias("key"), F.xxhash64(text).alias("hash"), F.col(text).alias("text")).filter("text is not null")
    found = rows.select("key", F.struct(F.length("text").alias("n"), "hash").alias("row")).join(marks, "key").groupBy("key", "mark").agg(F.min("row").alias("row"))
    found = found.select("key", "mark", "row.hash", F.least("row.n", F.lit(SAMPLE_CHARS)).alias("n"), (F.col("row.n") > SAMPLE_CHARS).alias("long"), F.xxhash64(F.lit(seed), "key").alias("order"))
    least = lambda mark, most: found.filter(F.col("mark") == mark).orderBy("long", "order", "key").limit(most)
    before = F.sum("n").over(Window.partitionBy("mark").orderBy("long", "order", "key").rowsBetween(Window.unboundedPreceding, -1))
    chosen = least(1, toxic).unionByName(least(0, clean)).withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < CLASS_CHARS)
    texts = rows.join(F.broadcast(chosen.select("key", "hash", "mark")), ["key", "hash"])
    return texts.select("key", "mark", F.substring("text", 1, SAMPLE_CHARS).alias("text")).dropDuplicates(["key"])


def _learned(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, toxic: int, clean: int) -> Model:
    """The model, fitted in one task on the bounded sample; only the weights of the buckets come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((x["key"], x["mark"], x["text"]) for batch in batches for x in batch.to_pylist())
        model = fit([t for *_, t in rows], np.array([float(m) for _, m, _ in rows]))
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype(np.float32).tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], names=["weights", "bias"])

    found = sample(docs, labels, doc_id, text, toxic, clean).repartition(1).mapInArrow(run, "weights binary, bias double").first()
    return Model(np.frombuffer(found["weights"], np.float32), found["bias"]) if found else fit([], np.zeros(0))


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> DataFrame:
    """Toxicity of every row: doc_id, held_out, score (0 to 1), predicted (1 from score 0.5 on).

    Learns from a bounded sample of labelled rows outside the held-out fold; null labels count as
    none, and with labels of one class only, or none, every score is the class's rate. Whole texts are
    scored by their words alone; null and empty texts have the score of an empty bag. ``labels``
    has the id's name and ``toxic``; other columns of both tables are ignored. Rows that repeat stay.
    """
    model = _learned(docs, labels, doc_id, text, toxic, clean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch, words, counts in scored_batches(batches):
            scores = model.scores(table, words, counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("key"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> DataFrame:
    """``docs`` without the rows that ``score_documents`` predicts to be toxic; all columns stay.

    Rows without words, null texts among them, have nothing toxic in them and stay, whatever the score
    of an empty bag. Rows that repeat stay or go together; null labels, and labels of one class or none,
    count as in ``score_documents``. An empty table stays empty; columns of any other names are left as they are.
    """
    model = _learned(docs, labels, doc_id, text, toxic, clean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch, words, counts in scored_batches(batches, text=text):
            yield batch.filter(pa.array((model.scores(table, words, counts) < 0.5) | (counts == 0)))

    return docs.mapInArrow(run, docs.schema)
