"""The corpus operators as queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.llm import divergence, exact, langid, lines, mixing, near, passages, pieces, secrets, tokenfile, topk, toxicity, whitening
from rulewright.sources.tables import table


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; the same on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words a mix of all documents takes of each, by its source's target."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's ids lie in a token file of all documents, and their checksum, read back from the file."""
    return tokenfile.token_file(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document stays of each group of equal texts."""
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that lose paragraphs or passages that stand in an earlier one, with the spans."""
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of each document."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of each document at a similarity of 0.85."""
    return near.near_groups(table(spark, sf_dir, "documents"), percent=85)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document."""
    return langid.predict(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The piece ids of each document, and whether they decode to its text."""
    return pieces.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest inner products of each fiftieth vector with all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text without the later occurrences of repeated three-line windows, and how many lines went."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.drop_repeated_lines(docs, counts="counts").select("doc_id", "counts.n_lines", "counts.removed_lines", "text")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source's terms lie from its peers' and its language's."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of each document: counts by pattern, a checksum of the patterns' spans, and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs, secrets.fitted(secrets.labelled_samples(docs)))
    counts = [F.size(F.filter("spans", secrets.of_kinds(kind))).cast("long").alias(f"n_{kind}") for kind in secrets.KINDS[:3]]
    base = F.filter("spans", secrets.of_kinds(*secrets.KINDS[:3]))
    return found.select("doc_id", *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on their four largest principal components, whitened."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_source_mix": op1_source_mix,
    "op2_token_file": op2_token_file,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_near_dedup": op6_near_dedup,
    "op7_language_id": op7_language_id,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_top_k": op9_top_k,
    "op10_line_dedup": op10_line_dedup,
    "op11_divergence": op11_divergence,
    "op12_secrets": op12_secrets,
    "op13_whitening": op13_whitening,
}

ORACLES = {
    "op3_exact_dedup": """
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
        FROM d""",
    "op9_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op10_line_dedup": """
        WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos, len(ls) AS n FROM d),
        w AS (SELECT doc_id, pos, n, [line, lead(line, 1) OVER (PARTITION BY doc_id ORDER BY pos), lead(line, 2) OVER (PARTITION BY doc_id ORDER BY pos)] AS w FROM l),
        r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS k FROM w WHERE pos + 3 <= n),
        gone AS (SELECT DISTINCT doc_id, pos + s AS pos FROM r, (SELECT unnest([0, 1, 2]) AS s) WHERE k > 1),
        j AS (SELECT l.doc_id, l.pos, l.line, l.n, gone.pos IS NOT NULL AS gone FROM l LEFT JOIN gone USING (doc_id, pos))
        SELECT d.doc_id, coalesce(any_value(j.n), 0)::INT AS n_lines, coalesce(sum(j.gone::INT), 0)::INT AS removed_lines,
               CASE WHEN any_value(d.text) IS NULL THEN NULL ELSE coalesce(string_agg(j.line, chr(10) ORDER BY j.pos) FILTER (WHERE NOT j.gone), '') END AS text
        FROM d LEFT JOIN j USING (doc_id) GROUP BY d.doc_id""",
    "op11_divergence": """
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
        w AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
        c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
        k AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
        t AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        s AS (SELECT lang, source, sum(c.n)::HUGEINT AS total FROM c JOIN k USING (lang, term) GROUP BY ALL),
        p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                     1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(s.total, 0) + 5 * t.v) AS p,
                     1 + (1000000000::HUGEINT * (k.n + 5)) // (t.total + 5 * t.v) AS q
              FROM g JOIN k USING (lang) JOIN t USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                  LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
        terms AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
        u AS (SELECT *, 'pair' AS part FROM pairs UNION ALL SELECT *, 'term' AS part FROM terms)
        SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
        FROM u QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 50""",
    "op12_secrets": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        pat AS (SELECT unnest([0, 1, 2, 3]) AS kind, unnest(['assign', 'access', 'hex', 'random']) AS name, unnest([
                    '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)',
                    'AKIA[A-Z0-9]+', '[0-9a-f]+', '[A-Za-z0-9+/_=-]{20,}']) AS re),
        h AS (SELECT list_filter(regexp_extract_all(t, '[A-Za-z0-9+/_=-]{4,}'), lambda x: len(x) < 20) AS t FROM d
              WHERE ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT < (SELECT least(4294967296, (200 * 4294967296) // greatest(count(*), 1)) FROM d)),
        samples AS (
            SELECT DISTINCT unnest(t || list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1]) || list_transform(range(1, len(t)), lambda i: t[i] || '-' || t[i + 1])
                                     || list_transform(range(1, len(t)), lambda i: t[i] || '/' || t[i + 1]) || list_transform(range(1, len(t)), lambda i: t[i] || upper(t[i + 1][1]) || t[i + 1][2:])) AS sample, 0 AS random FROM h
            UNION ALL SELECT unnest([to_base64(unhex(sha256(t))), translate(to_base64(unhex(sha256(t))), '+/', '-_'), sha256(t), upper(sha256(t))]), 1 FROM (SELECT DISTINCT unnest(t) AS t FROM h)),
        abc AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-' AS abc),
        steps AS (SELECT random, CASE WHEN i > 1 THEN instr(abc, sample[i - 1]) ELSE 0 END AS state, instr(abc, sample[i]) AS next FROM (SELECT sample, random, unnest(range(1, len(sample) + 1)) AS i FROM samples), abc),
        counts AS (SELECT state, next, sum(random) AS r, sum(1 - random) AS o FROM steps GROUP BY ALL),
        totals AS (SELECT state, sum(r) AS rs, sum(o) AS os FROM counts GROUP BY ALL),
        grid AS (SELECT *, unnest(range(1, 68)) AS next FROM totals),
        w AS (SELECT g.state, g.next, round(1000 * (ln((coalesce(r, 0) + 1) / (rs + 67)) - ln((coalesce(o, 0) + 1) / (os + 67))))::INT AS w FROM grid g LEFT JOIN counts c ON c.state = g.state AND c.next = g.next),
        m AS (SELECT r, kind, name, re, regexp_extract_all(t, re) AS ms, string_split_regex(t, re) AS ps FROM d, pat WHERE kind < 2 OR regexp_matches(t, '[A-Za-z0-9+/_=-]{20}')),
        u AS (SELECT r, kind, name, re, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS p, generate_subscripts(ms, 1) AS i FROM m WHERE len(ms) > 0),
        s AS (SELECT r, kind, name, re, m, (sum(len(p) + len(m)) OVER (PARTITION BY r, kind ORDER BY i))::INT AS e FROM u),
        base AS (SELECT r, kind, name, e - len(m) AS b, e FROM s WHERE (kind = 0 AND len(regexp_extract(m, re, 2)) >= 6) OR (kind = 1 AND len(m) >= 20) OR (kind = 2 AND len(m) >= 24)),
        cand AS (SELECT r, e - len(m) AS b, e, m FROM s WHERE kind = 3 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')),
        chars AS (SELECT r, b, e, m, unnest(range(1, len(m) + 1)) AS i FROM cand),
        scored AS (SELECT r, b, e, sum(w.w) AS score FROM chars, abc JOIN w ON w.state = CASE WHEN i > 1 THEN instr(abc, m[i - 1]) ELSE 0 END AND w.next = instr(abc, m[i]) GROUP BY ALL),
        every AS (SELECT * FROM base UNION ALL
                  SELECT r, 3, 'random', b, e FROM scored c WHERE score >= 12000 AND NOT EXISTS (SELECT 1 FROM base x WHERE x.r = c.r AND x.b < c.e AND x.e > c.b))
        SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
               sha256(coalesce(string_agg(name || ':' || b || ':' || e, ',' ORDER BY b, kind) FILTER (kind < 3), '')) AS base_sha256,
               coalesce(string_agg(name || ':' || b || ':' || e, ',' ORDER BY b, kind), '') AS spans
        FROM d LEFT JOIN every USING (r) GROUP BY r, doc_id""",
}
