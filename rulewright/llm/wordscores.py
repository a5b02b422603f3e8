"""Scores of distinct words, remembered by each Python worker up to a bound."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from rulewright.llm.common import slices

CACHE_WORDS = 300_000
FOLDS = 5


class WordTable:
    """Rows of numbers by word; ``score`` makes them for many new words at a time."""

    def __init__(self, score: Callable[[list[bytes]], np.ndarray], most: int = CACHE_WORDS):
        self.score, self.most = score, most
        self.index: dict[bytes, int] = {}
        self.rows = score([])

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """The rows of ``words``, in their order."""
        new = set(words) - self.index.keys()
        if new and len(self.index) + len(new) > self.most:
            self.index.clear()
            self.rows = self.rows[:0]
            new = set(words)
        if new:
            fresh = sorted(new)
            self.index.update(zip(fresh, range(len(self.rows), len(self.rows) + len(fresh)), strict=True))
            self.rows = np.concatenate((self.rows, self.score(fresh)))
        return self.rows[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))]


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words of a text in UTF-8, as runs between blanks; none for null."""
    return text.lower().encode("utf-8", "replace").split() if text else []


def scored_batches(batches: Iterator[pa.RecordBatch], key: str = "key", text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes], np.ndarray]]:
    """Slices of rows with all their words in order and each row's number of words."""
    for batch in slices(batches, text, 2 << 20, 1000):
        words = [words_of(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        yield batch, [w for ws in words for w in ws], np.array([len(ws) for ws in words], np.int64)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's decimal text is divisible by five; true for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))
