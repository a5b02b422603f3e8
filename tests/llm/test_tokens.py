"""Token files, SentencePiece ids, source mixing and top-k against the libraries and plain Python."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from rulewright.llm import mixing, pieces, tokenfile, topk
from rulewright.llm.queries import tokenizer_path


def test_elias_fano_selects_every_value():
    rng = np.random.default_rng(2)
    for n, top in ((1, 0), (1, 5), (300, 10), (2000, 10**9), (1000, 1000)):
        values = np.sort(rng.integers(0, top + 1, n))
        coded = tokenfile.EliasFano.encode(values, top)
        assert (coded.values() == values).all()
        assert all(coded.select(i) == values[i] for i in range(0, n, max(1, n // 50)))
    with pytest.raises(IndexError):
        coded.select(n)
    assert len(tokenfile.EliasFano.encode(np.zeros(0, np.int64), 0).values()) == 0


def test_token_file(corpus, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = collections.defaultdict(list)
    rows = tokenfile.token_file(corpus, path).collect()
    for r in rows:
        got[r.doc_id].append(r)
    want = collections.defaultdict(list)
    for r in corpus.collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want[r.doc_id].append((len(ids), zlib.crc32(ids.tobytes())))
    assert {d: sorted((r.n_tokens, r.ids_crc32) for r in rs) for d, rs in got.items()} == {d: sorted(x) for d, x in want.items()}
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    in_order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    known = [d for d in in_order if d is not None]
    assert known == sorted(known) and in_order[: len(in_order) - len(known)] == [None] * (len(in_order) - len(known))
    assert tokenfile.token_file(empty, path).count() == 0


def test_word_encoder_on_odd_texts(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenfile, "CACHE_WORDS", 50)
    path = tokenizer_path("byte_bpe_50k.json")
    tok, coder = Tokenizer.from_file(path), tokenfile.WordEncoder(path)
    random.seed(6)
    texts = ["".join(random.choice("ab é\n\t  .1'日") for _ in range(random.randint(0, 40))) for _ in range(600)] + ["", " ", "a  b", "a\x1cb \x85 c", "a\xa0 b"]
    for i in range(0, len(texts), 20):
        for text, ids in zip(texts[i : i + 20], coder.encode(texts[i : i + 20]), strict=True):
            assert np.frombuffer(ids, coder.dtype).tolist() == tok.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def model():
    return tokenizer_path("piece_bpe_32k.model")


def test_pieces_are_the_library_s(model):
    import sentencepiece

    library, coder = sentencepiece.SentencePieceProcessor(model_file=model), pieces.PieceEncoder(model)
    random.seed(8)
    texts = ["", " ", "a  b", "\n\n a\t\tb", "x▁y", "<s> </s> <unk> <0x0A>", "日本語" * 60, "é 😀", "aaaa" * 200, "\x00\x01", "=====  ---- .......", "f(x);\r\n  g"]
    texts += ["".join(random.choice("abcdet ▁\n.e1é語\r;") for _ in range(random.randint(1, 60))) for _ in range(800)]
    texts += ["".join(random.choice("abcdethsrnio") for _ in range(900)) for _ in range(5)]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text)
        assert coder.decode(ids) == library.decode(library.encode(text))


def test_suffix_array_and_occurrences():
    text = "abracadabra abra"
    codes = np.array([ord(c) for c in text], np.int32)
    order = pieces.suffix_array(codes, 16)
    assert [text[i:] for i in order] == sorted(text[i:] for i in range(len(text)))
    names = ["a", "abra", "cad", "x", "ra a"]
    table = np.zeros((len(names), 4), np.int32)
    for i, n in enumerate(names):
        table[i, : len(n)] = [ord(c) for c in n]
    low, high = pieces.occurrences(codes, order, table, np.array([len(n) for n in names]))
    found = [sorted(order[a:b].tolist()) for a, b in zip(low, high, strict=True)]
    assert found == [[m.start() for m in re.finditer(f"(?={n})", text)] for n in names]


def test_encode_documents(corpus, empty, model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model)
    got = pieces.encode_documents(corpus, model, decoded=True)
    rows = got.collect()
    want = collections.Counter((r.doc_id, tuple(library.encode(r.text or "")), r.text or "") for r in corpus.collect())
    assert collections.Counter((r.doc_id, tuple(r.ids), r.decoded) for r in rows) == want
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    again = collections.Counter((r.doc_id, r.text) for r in pieces.decode_documents(got, model).collect())
    assert again == collections.Counter((d, t) for d, _, t in want.elements())
    assert pieces.encode_documents(empty, model).count() == 0


def word_count(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def check_mix(df):
    rows = mixing.mix(df).collect()
    assert collections.Counter((r.doc_id, r.size) for r in rows) == collections.Counter((r.doc_id, word_count(r.text)) for r in df.collect())
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += r.size
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, most = sum(sizes.values()), {s: 3.0 * sizes[s] for s in names}
    target, open_ = {}, set(names)
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > most[s]}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: most[s] for s in over}
        open_ -= over
    taken = collections.Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size and abs(r.target - target[r.source]) < 1e-6 * max(1, total)
    assert all(abs(taken[s] - target[s]) <= max(20, 0.01 * total) for s in names)


def test_mix(corpus):
    check_mix(corpus)
    key = lambda df: sorted(map(str, mixing.mix(df).collect()))
    assert key(corpus) == key(corpus.repartition(2))


def test_mix_of_small_and_empty_tables(corpus, empty):
    assert mixing.mix(empty).count() == 0
    assert {r.taken for r in mixing.mix(corpus.filter("doc_id in (400, 401, 402)")).collect()} == {0}
    check_mix(corpus.filter("doc_id = 403"))


def test_mixed_rows_take_effect(corpus):
    taken = collections.Counter()
    for r in mixing.mix(corpus).collect():
        taken[r.source] += r.taken
    out = mixing.mixed(corpus)
    assert out.columns == corpus.columns
    got = collections.Counter()
    own = {(r.doc_id, r.text) for r in corpus.collect()}
    for r in out.collect():
        got[r.source] += word_count(r.text)
        assert (r.doc_id, r.text) in own or any(d == r.doc_id and t.startswith(r.text) for d, t in own if t)
    # rows that repeat share what is taken, rounded down
    assert all(0 <= taken[s] - got[s] <= 2 for s in taken)


def brute_force(rows, k):
    vectors = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    queries = {}
    for i, v in vectors:
        if i % 50 == 0 and (i not in queries or tuple(v) < tuple(queries[i])):
            queries[i] = v
    out = {}
    for q, v in queries.items():
        dot = lambda w: int(sum(int(a) * int(b) for a, b in zip(v, w, strict=False)))
        out[q] = sorted(((-dot(w), i) for i, w in vectors if i != q))[:k]
    return out


def check_top(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, score string")
    got = collections.defaultdict(list)
    for r in topk.top_k(df, df["vec_id"] % 50 == 0, **options).collect():
        got[r.query_id].append((r.rank, -r.score, r.vec_id))
    want = brute_force([(r.vec_id, r.embedding) for r in df.collect()], 5)
    assert {q: sorted(x) for q, x in got.items()} == {q: [(n + 1, *x) for n, x in enumerate(xs)] for q, xs in want.items() if xs}


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.2, 16).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(2000, [float("nan")] * 16), (2050, None), (2100, [None, 0.5]), (None, rows[1][1]), (2150, [0.5, -0.25]), (2201, []), (50, rows[50][1]), (7, rows[9][1])]
    check_top(spark, rows)
    check_top(spark, rows, candidates=64, queries=4)


def test_top_k_with_large_numbers_and_few_rows(spark):
    check_top(spark, [(0, [1e6, -3e6]), (1, [2e6, 5e5]), (50, [1e6, 1.0])])
    check_top(spark, [(0, [1.0])])
    check_top(spark, [])


def test_sorted_lists_stop_early():
    rng = np.random.default_rng(9)
    vectors = rng.integers(-50, 50, (4000, 3))
    vectors[:5] = 10_000
    query, stops = np.array([[1, 1, 1], [1, -1, 0]]), collections.Counter()
    q, ids, scores = topk.best_of_block(np.array([-1, -2]), query, np.arange(4000), vectors, 5, stops)
    assert ids[q == -1].tolist() == [0, 1, 2, 3, 4] and set(scores[q == -1]) == {30_000}
    # the first query is done at the first look, the second has ties up to far down its lists
    assert stops[topk.DEPTHS[0]] >= 1 and stops.total() == 2
    want = sorted(range(4000), key=lambda i: (-(vectors[i] @ query[1]), i))[:5]
    assert ids[q == -2].tolist() == want
