"""SentencePiece encoding and decoding by suffix-array matching, for BPE models with byte fallback.

The distinct words of a batch are concatenated and indexed by a suffix array, sorted as far as
the longest piece reaches. Every piece of the vocabulary is binary-searched in it, which gives all
its occurrences as a range; the occurrences are edges from a position to a later one. The edges
are sorted by position and then relaxed: each word starts as single characters, and of the edges
that span exactly two neighbouring symbols the best-scored, leftmost one joins them, until none is
left. What no piece covers falls back to bytes.

Words are cut where no piece of the vocabulary can reach across, which is checked when a model is
loaded; so a word's ids are the same in every text, and each Python worker remembers them.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.llm.common import slices

SPACE = "▁"
#: Characters of new words that are indexed at a time, and words that a worker remembers at most.
BATCH_CHARS, CACHE_WORDS = 1 << 18, 300_000
#: From this length on a word is relaxed with a heap instead of round by round.
LONG_WORD = 192
_ALONE = "\n\t\x0b\x0c"


class Vocabulary:
    """The pieces of a model file: code points, lengths, scores, and the ids of single bytes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.texts = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.byte_ids = {int(self.texts[i][1:-1], 16): i for i in range(size) if model.is_byte(i)}
        if len(self.byte_ids) != 256:
            raise ValueError(f"{path}: a model with byte fallback is asked for")
        for i in plain:
            if len(self.texts[i]) > 1 and (SPACE in self.texts[i].lstrip(SPACE) or any(c in self.texts[i] for c in _ALONE)):
                raise ValueError(f"{path}: piece {i} reaches across a word's end")
        self.ids = np.array(plain, np.int32)
        self.lengths = np.array([len(self.texts[i]) for i in plain], np.int64)
        self.longest = int(self.lengths.max())
        self.codes = np.zeros((len(plain), self.longest), np.int32)
        for row, i in enumerate(plain):
            self.codes[row, : len(self.texts[i])] = [ord(c) for c in self.texts[i]]
        self.scores = np.full(size + 1, -np.inf)
        self.scores[self.ids] = [model.get_score(i) for i in plain]
        self.bytes = [b"" if model.is_control(i) else self.texts[i].replace(SPACE, " ").encode() for i in range(size)]
        for byte, i in self.byte_ids.items():
            self.bytes[i] = bytes([byte])


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``codes`` in the order of the ``depth`` or more codes from there on, by prefix doubling."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
    reach = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - reach)] = rank[reach:]
        both = rank * (n + 2) + after
        order = np.argsort(both, kind="stable")
        reach *= 2
        if reach >= depth:
            return order
        ordered = both[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([1], ordered[1:] != ordered[:-1])))


def occurrences(codes: np.ndarray, order: np.ndarray, pieces: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range [low, high) of the suffix array ``order`` at whose positions each piece begins.

    All pieces are searched at once, one code after the other, each by two binary searches.
    """
    n = len(codes)
    padded = np.append(codes, np.zeros(pieces.shape[1], codes.dtype))
    low, high = np.zeros(len(pieces), np.int64), np.full(len(pieces), n, np.int64)
    for at in range(pieces.shape[1]):
        some = np.flatnonzero((lengths > at) & (low < high))
        if not len(some):
            break
        wanted = pieces[some, at]
        ends = []
        for after in (False, True):
            a, b = low[some].copy(), high[some].copy()
            while (open_ := a < b).any():
                middle = (a + b) >> 1
                code = padded[order[np.minimum(middle, n - 1)] + at]
                right = open_ & ((code <= wanted) if after else (code < wanted))
                a = np.where(right, middle + 1, a)
                b = np.where(open_ & ~right, middle, b)
            ends.append(a)
        low[some], high[some] = ends
    return low, high


class PieceEncoder:
    """Encodes and decodes whole texts with one model, remembering words."""

    _words = re.compile(f"[{_ALONE}]|{SPACE}*[^{SPACE}{_ALONE}]+|{SPACE}+")

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.seen: dict[str, bytes] = {}

    def _edges(self, codes: np.ndarray) -> np.ndarray:
        """For each position a row of pieces that begin there, by length; -1 where none does."""
        v = self.vocabulary
        order = suffix_array(codes, v.longest)
        low, high = occurrences(codes, order, v.codes, v.lengths)
        counts = high - low
        hit = np.flatnonzero(counts > 0)
        counts = counts[hit]
        places = np.repeat(low[hit] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        at, piece = order[places], np.repeat(hit, counts)
        by = np.argsort(at * (v.longest + 1) + v.lengths[piece])
        table = np.full((len(codes), v.longest + 1), -1, np.int32)
        table[at[by], v.lengths[piece][by]] = v.ids[piece][by]
        return table

    def _relaxed(self, edges: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which positions begin a symbol, once every word is relaxed."""
        v = self.vocabulary
        begins = np.zeros(len(edges), bool)
        for a, n in zip(starts.tolist(), sizes.tolist(), strict=True):
            begins[a : a + n] = True
        for a, n in zip(starts[sizes > LONG_WORD].tolist(), sizes[sizes > LONG_WORD].tolist(), strict=True):
            self._relax_long(edges, begins, a, n)
        short = np.flatnonzero((sizes > 1) & (sizes <= LONG_WORD))
        for width in np.unique(-(-sizes[short] // 8)) * 8 if len(short) else ():
            of = short[-(-sizes[short] // 8) * 8 == width]
            first, n = starts[of], sizes[of]
            column = np.arange(width)
            follow = np.minimum(column + 1, width)[None, :] + np.zeros((len(of), 1), np.int64)
            before = (column - 1)[None, :] + np.zeros((len(of), 1), np.int64)
            place = np.minimum(first[:, None] + column, len(edges) - 1)
            score = v.scores[edges[place, 2]]
            score[column[None, :] + 1 >= n[:, None]] = -np.inf
            rows = np.arange(len(of))
            while len(rows):
                best = score[rows].argmax(axis=1)
                good = score[rows, best] > -np.inf
                rows, best = rows[good], best[good]
                if not len(rows):
                    break
                gone = follow[rows, best]
                begins[first[rows] + gone] = False
                score[rows, gone] = -np.inf
                after = follow[rows, gone]
                follow[rows, best] = after
                inside = after < n[rows]
                before[rows[inside], after[inside]] = best[inside]
                self._pair(edges, score, follow, first, n, rows, best)
                left = before[rows, best]
                some = left >= 0
                self._pair(edges, score, follow, first, n, rows[some], left[some])
        return begins

    def _pair(self, edges: np.ndarray, score: np.ndarray, follow: np.ndarray, first: np.ndarray, n: np.ndarray, rows: np.ndarray, left: np.ndarray) -> None:
        """Scores of the symbols at ``left`` joined with the ones after them."""
        right = follow[rows, left]
        inside = right < n[rows]
        end = np.where(inside, follow[rows, np.minimum(right, follow.shape[1] - 1)], 0)
        length = np.minimum(end, n[rows]) - left
        fits = inside & (length <= self.vocabulary.longest)
        piece = edges[first[rows] + left, np.where(fits, length, 0)]
        score[rows, left] = np.where(fits, self.vocabulary.scores[piece], -np.inf)

    def _relax_long(self, edges: np.ndarray, begins: np.ndarray, a: int, n: int) -> None:
        longest, scores = self.vocabulary.longest, self.vocabulary.scores
        follow, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap: list[tuple[float, int, int, int]] = []

        def offer(left: int) -> None:
            right = follow[left]
            if right < n and follow[right] - left <= longest and (piece := edges[a + left, follow[right] - left]) >= 0:
                heapq.heappush(heap, (-scores[piece], left, right, follow[right]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, left, right, end = heapq.heappop(heap)
            if not (alive[left] and follow[left] == right and right < n and follow[right] == end):
                continue
            alive[right] = False
            begins[a + right] = False
            follow[left] = end
            if end < n:
                before[end] = left
                offer(left)
            if before[left] >= 0:
                offer(before[left])

    def _learn(self, words: list[str]) -> None:
        v = self.vocabulary
        at = 0
        while at < len(words):
            run, size = [], 0
            while at < len(words) and (not run or size + len(words[at]) <= BATCH_CHARS):
                run.append(words[at])
                size += len(words[at]) + 1
                at += 1
            codes = np.frombuffer("\0".join(run).encode("utf-32-le", "surrogatepass"), np.int32)
            sizes = np.array([len(w) for w in run], np.int64)
            starts = np.cumsum(sizes + 1) - sizes - 1
            edges = self._edges(codes)
            symbols = np.flatnonzero(self._relaxed(edges, starts, sizes))
            owner = np.searchsorted(starts, symbols, "right") - 1
            ends = np.append(symbols[1:], len(codes))
            ends = np.minimum(ends, starts[owner] + sizes[owner])
            ids = edges[symbols, ends - symbols]
            if (ids < 0).any():
                ids, owner = self._with_bytes(codes, symbols, ids, owner)
            edges_of = np.searchsorted(owner, np.arange(len(run) + 1)) * 2
            data = ids.astype("<u2" if len(v.texts) < 1 << 16 else "<u4").tobytes()
            width = len(data) // max(1, len(ids)) // 2
            bounds = (edges_of * width).tolist()
            self.seen.update(zip(run, (data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)), strict=True))

    def _with_bytes(self, codes: np.ndarray, symbols: np.ndarray, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters replaced by the ids of their UTF-8 bytes."""
        parts = [[int(i)] if i >= 0 else [self.vocabulary.byte_ids[b] for b in chr(codes[s]).encode("utf-8", "replace")] for s, i in zip(symbols, ids, strict=True)]
        return np.array([i for p in parts for i in p], np.int32), np.repeat(owner, [len(p) for p in parts])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts; an empty text has none."""
        split = [self._words.findall((SPACE + t).replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.seen) > CACHE_WORDS:
            self.seen.clear()
        new = {w for ws in split for w in ws} - self.seen.keys()
        self._learn(sorted(new))
        get = self.seen.__getitem__
        kind = "<u2" if len(self.vocabulary.texts) < 1 << 16 else "<u4"
        return [np.frombuffer(b"".join(map(get, ws)), kind).astype(np.int32) for ws in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces and bytes joined, without the space that encoding put before it."""
        text = b"".join(map(self.vocabulary.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def encode_documents(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """Ids of every whole text: doc_id, n_tokens, ids, round_trip, and with ``decoded`` the text decoded from them.

    ``model`` is the path of a SentencePiece BPE model with byte fallback on every executor. Null
    and empty texts have no ids. round_trip tells whether decoding gives the text again, which
    fails only for texts that hold the space mark U+2581 itself; null counts as empty. Rows that
    repeat stay, an empty table gives an empty result, and other columns are ignored.
    """
    names = ["doc_id", "n_tokens", "ids", "round_trip", *["decoded"] * decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model)
        for batch in slices(batches, "text", 1 << 20, 1000):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = coder.encode(texts)
            again = [coder.decode(x) for x in ids]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
            columns = [batch.column(0), pa.array(np.diff(ends), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array([a == b for a, b in zip(texts, again, strict=True)])]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(again, pa.string())] * decoded], names=names)

    rows = docs.select(F.col(doc_id).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean" + ", decoded string" * decoded)


def decode_documents(tokens: DataFrame, model: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """The texts of id arrays: doc_id, text. Null and empty arrays give empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model)
        for batch in batches:
            texts = [coder.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, text string")
