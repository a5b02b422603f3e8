"""Queries that package rows for training and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.functions import geometry as G
from rulewright.functions import text as T
from rulewright.operators import packages as P
from rulewright.operators import scores as S
from rulewright.plans.catalog import query
from rulewright.plans.geometry import grids
from rulewright.plans.texts import QUESTIONS_SQL, questions
from rulewright.sources.tables import table

_SHARE = "s AS (SELECT vec_id AS doc_id, list_sum(list_transform(embedding, lambda x: (x::DOUBLE >= 0.05)::INT)) / 64 AS share FROM embeddings WHERE len(embedding) = 64)"


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), G.active_share(F.col("bits")).alias("share"))


@query(f"""WITH {_SHARE} SELECT doc_id, CASE WHEN share > 0 AND share <= 0.35 THEN 'mask' ELSE 'none' END AS supervision, share IS NULL OR share <= 0.35 AS stays FROM documents LEFT JOIN s USING (doc_id)""")
def p1_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a mask of fitting area, and those that a filter by area would keep."""
    docs, shares = table(spark, sf_dir, "documents").select("doc_id"), _shares(spark, sf_dir)
    stays = P.without_large(docs, shares, "doc_id", 0.35).withColumn("stays", F.lit(True))
    return P.supervised(docs, shares, "doc_id", 0.35).join(stays, "doc_id", "left").select("doc_id", "supervision", F.coalesce("stays", F.lit(False)).alias("stays"))


@query("""SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'dropped' ELSE 'kept' END AS part FROM customer""")
def p2_parted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with and without a pending order, as two parts of one result."""
    ids = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    kept, dropped = P.parted(table(spark, sf_dir, "customer").select("c_custkey"), ids, "c_custkey")
    return kept.withColumn("part", F.lit("kept")).unionByName(dropped.withColumn("part", F.lit("dropped")))


@query("""SELECT doc_id, regexp_matches(replace(lower(text), 'on the', ' '), '(^|[^a-z])(the|of)([^a-z]|$)') AS english, regexp_matches(lower(text), '(^|[^a-z])(de|la|le)([^a-z]|$)') AS romance FROM documents""")
def p3_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that mention words strictly, with an excluded phrase."""
    low = F.lower("text")
    return table(spark, sf_dir, "documents").select("doc_id", P.mentions(low, ["the", "of"], ["on the"]).alias("english"), P.mentions(low, ["de", "la", "le"]).alias("romance"))


@query("""WITH a AS (SELECT o_orderkey, 0 AS part, o_orderpriority AS text FROM orders WHERE o_orderkey % 5 < 3), b AS (SELECT o_orderkey, 1, lower(o_orderpriority) FROM orders WHERE o_orderkey % 5 BETWEEN 2 AND 3),
    u AS (SELECT o_orderkey, count(*) AS n, arg_min(text, part) AS text FROM (FROM a UNION ALL FROM b) GROUP BY 1)
    SELECT o_orderkey, text, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' END AS problem FROM orders LEFT JOIN u USING (o_orderkey)""")
def p4_merged_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of two chunks with those that are missing or repeated."""
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 5
    parts = [orders.filter(k < 3).select("o_orderkey", F.col("o_orderpriority").alias("text")), orders.filter(k.between(2, 3)).select("o_orderkey", F.lower("o_orderpriority").alias("text"))]
    return P.merged_predictions(parts, orders.select("o_orderkey"), "o_orderkey").select("o_orderkey", "text", "problem")


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey % 4 AS worker, l_extendedprice FROM lineitem) SELECT * FROM w QUALIFY worker = min(worker) OVER (PARTITION BY l_orderkey, l_linenumber)""")
def p5_first_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the first worker that has a key, as a block."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_suppkey") % 4).alias("worker"), "l_extendedprice")
    return P.first_block(rows, ["l_orderkey", "l_linenumber"], "worker")


@query("""SELECT conv_id, turn, (dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS stage FROM conversations WHERE role <> 'system'""")
def p6_renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns numbered without gaps after the system's ones went."""
    return P.renumbered(table(spark, sf_dir, "conversations").filter("role <> 'system'").select("conv_id", "turn"), "conv_id", "turn", "stage")


@query(f"""WITH {QUESTIONS_SQL} SELECT question_id, 'original' AS variant, question, answer FROM q UNION ALL SELECT question_id, 'counter', lower(question), upper(answer) FROM q""")
def p7_counter_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question as two rows, the original and a counter-example."""
    rows = questions(spark, sf_dir).withColumns({"other_question": F.lower("question"), "other_answer": F.upper("answer")})
    return P.counter_examples(rows, ["question_id"], {"original": ("question", "answer"), "counter": ("other_question", "other_answer")})


@query("""SELECT p_partkey, p_name || chr(10) || CASE p_partkey % 3 WHEN 0 THEN 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || 'C. x' WHEN 1 THEN 'A. ' || p_brand ELSE '' END AS prompt FROM part""")
def p8_choice_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with lettered options, cut at the first that is missing."""
    k = F.col("p_partkey") % 3
    options = F.array(F.when(k == 2, F.lit("None")).otherwise(F.col("p_brand")), F.when(k == 0, F.col("p_type")), F.lit("x"))
    return table(spark, sf_dir, "part").select("p_partkey", P.choice_prompt(F.col("p_name"), options).alias("prompt"))


@query("""WITH t AS (SELECT p_partkey, string_split(lower('is it the ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN ' or ' || p_type ELSE '' END), ' ') AS w FROM part),
    s AS (SELECT p_partkey, array_to_string(w, ' ') AS text, list_position(w, 'or') AS at_or, w FROM t)
    SELECT p_partkey, CASE WHEN at_or > 1 AND at_or < len(w) THEN array_to_string(w[greatest(1, at_or - 4):at_or - 1], ' ') || '|' || array_to_string(w[at_or + 1:at_or + 4], ' ') ELSE '' END AS options,
      len(list_distinct(flatten([[array_to_string(w[i:i + n - 1], ' ') for n in range(1, least(3, len(w) - i + 1) + 1)] for i in range(1, len(w) + 1)]))) AS spans FROM s""")
def p9_choices_and_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options around or, and the number of distinct spans of up to three tokens."""
    text = F.concat(F.lit("is it the "), F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" or "), F.col("p_type"))).otherwise(""))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.split(F.lower(text), " ").alias("w"))
    return rows.select("p_partkey", F.array_join(P.choices_around_or(F.col("w")), "|").alias("options"), F.size(P.answer_spans(F.col("w"), 3)).cast("long").alias("spans"))


def _dealt_sql(source: str, length: str, order: str) -> str:
    """Rows ``r`` of (mega, place, n, length) and their shards ``z``, by least total length, one row after the other."""
    return f"""r AS (SELECT *, {length} AS l, row_number() OVER (PARTITION BY mega ORDER BY {length} DESC, {order}) - 1 AS place, count(*) OVER (PARTITION BY mega) AS n FROM {source}),
    s AS (SELECT DISTINCT mega, -1::BIGINT AS place, [0, 0, 0, 0]::DOUBLE[] AS loads, [0, 0, 0, 0]::BIGINT[] AS counts, 0::BIGINT AS at_ FROM r
          UNION ALL SELECT mega, place, [CASE WHEN i = at_ THEN CASE WHEN (counts[i] + 1) * 4 = n THEN 'inf'::DOUBLE ELSE x + l END ELSE x END for x, i in loads], [CASE WHEN i = at_ THEN x + 1 ELSE x END for x, i in counts], at_
          FROM (SELECT r.mega, r.place, r.l, r.n, s.loads, s.counts, list_position(s.loads, list_min(s.loads))::BIGINT AS at_ FROM s JOIN r ON r.mega = s.mega AND r.place = s.place + 1)),
    z AS (SELECT r.*, CASE WHEN n % 4 = 0 THEN at_ - 1 ELSE r.place % 4 END AS shard FROM r JOIN s USING (mega, place))"""


@query(f"""WITH RECURSIVE m AS (SELECT doc_id, n_chars, (row_number() OVER (ORDER BY md5((doc_id * 3) || ':3'), doc_id) - 1) // 64 AS mega FROM documents), {_dealt_sql('m', 'n_chars', 'doc_id')}
    SELECT doc_id * 3 AS doc_id, mega::BIGINT AS mega, place::INT AS place, shard::INT AS shard FROM z""")
def p10_length_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with gaps between their ids, shuffled, grouped by length within batches of 64 and dealt out to four shards evenly."""
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") * 3).alias("doc_id"), "n_chars")
    return P.length_groups(docs, "n_chars", "doc_id", 4, 16, seed=3).select("doc_id", "mega", "place", "shard")


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, n_chars + 1 AS len_, CASE WHEN doc_id % 3 = 0 THEN -1 ELSE 1 END AS side FROM documents),
    m AS (SELECT *, side || '|' || ((row_number() OVER (PARTITION BY side ORDER BY md5(doc_id || ':5'), doc_id) - 1) // 32) AS mega FROM d), {_dealt_sql('m', 'len_', 'doc_id')},
    x AS (SELECT *, string_split(mega, '|')[2]::BIGINT AS no FROM z), y AS (SELECT *, no = max(no) OVER (PARTITION BY side) AS last_ FROM x),
    b AS (SELECT side, no, row_number() OVER (ORDER BY md5(side || ':' || no || ':5')) - 1 AS new FROM (SELECT DISTINCT side, no FROM y WHERE NOT last_)),
    f AS (SELECT doc_id, new AS mega, row_number() OVER (PARTITION BY side, no ORDER BY shard, place) - 1 AS place FROM y JOIN b USING (side, no))
    SELECT doc_id, mega::BIGINT AS mega, place::INT AS place FROM f UNION ALL SELECT doc_id, (SELECT count(*) FROM b), (row_number() OVER (ORDER BY doc_id) - 1)::INT FROM y WHERE last_""")
def p20_modality_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of two modalities in batches of 32, of one modality each but for the last."""
    docs = table(spark, sf_dir, "documents").select("doc_id", ((F.col("n_chars") + 1) * F.when(F.col("doc_id") % 3 == 0, -1).otherwise(1)).alias("length"))
    return P.modality_groups(docs, "length", "doc_id", 4, 8, seed=5).select("doc_id", "mega", "place")


@query(f"""WITH {QUESTIONS_SQL}, t AS (SELECT CASE WHEN question_id % 3 = 0 THEN 'image' ELSE 'text' END AS kind, question_id % 7 < 3 AS correct, question_id % 5 + 1 AS a, question_id % 4 + 2 AS b FROM q)
    SELECT coalesce(kind, 'all') AS kind, count(*) AS n, round(100 * avg(correct::INT), 6) AS accuracy, round(avg(a), 6) AS first, round(avg(b), 6) AS second, round(100 * avg(b) / avg(a), 6) AS relative FROM t GROUP BY ROLLUP (kind)""")
def p11_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and review scores by kind and in all."""
    k = F.col("question_id")
    rows = questions(spark, sf_dir).select(F.when(k % 3 == 0, "image").otherwise("text").alias("kind"), (k % 7 < 3).cast("int").alias("correct"), (k % 5 + 1).alias("a"), (k % 4 + 2).alias("b"))
    accuracy = S.accuracy_by(rows, "kind", "correct")
    found = accuracy.join(S.review_means(rows, "kind", "a", "b"), "kind")
    return found.select("kind", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "first", "second", "relative")])


@query("""WITH c AS (SELECT user_id, event_type, count(*) FILTER (value > 30) AS tp, count(*) FILTER (value BETWEEN 10 AND 12) AS fp, count(*) FILTER (value < 1) AS fn FROM events GROUP BY 1, 2)
    SELECT user_id, event_type, tp, fp, fn, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 1 END, 9) AS f1 FROM c""")
def p12_phrase_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 of each (video, phrase), 1 where nothing is to be counted; users and types stand for them."""
    n = lambda c: F.count(F.when(F.expr(c), 1))
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(n("value > 30").alias("tp"), n("value between 10 and 12").alias("fp"), n("value < 1").alias("fn"))
    tp = F.col("tp")
    return rows.withColumn("f1", F.round(S.ratio(2 * tp, 2 * tp + F.col("fp") + F.col("fn"), 1.0), 9))


@query(f"""WITH {QUESTIONS_SQL}, a AS (SELECT question_id, lower(trim(answer)) AS a FROM q), v AS (SELECT a, count(*) AS n FROM a WHERE a <> '' GROUP BY a)
    SELECT a AS answer, n FROM v ORDER BY n DESC, a LIMIT 15""")
def p13_top_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen most frequent answers: the limit is the feature."""
    rows = questions(spark, sf_dir).select(F.lower(F.trim("answer")).alias("answer")).filter("answer <> ''")
    return S.top_values(rows, "answer", 15)


def _plain_sql(x: str) -> str:
    quote = lambda t: t.replace("'", "''")
    low = f"trim(regexp_replace(trim(replace(regexp_replace(lower({x}), '[,?]', '', 'g'), '''s', ' ''s')), '[\\n\\t]', ' ', 'g'))"
    out = low
    for m in map(quote, T.ANSWER_MARKS):
        out = f"replace({out}, '{m}', CASE WHEN contains(low, '{m} ') OR contains(low, ' {m}') THEN '' ELSE ' ' END)"
    words = f"string_split(trim(regexp_replace(regexp_replace(regexp_replace({out.replace(low, 'low')}, '\\.+([^0-9.]|$)', '\\1', 'g'), '\\.+(\\.[0-9])', '\\1', 'g'), '\\s+', ' ', 'g')), ' ')"
    table = {k: v for k, v in T.NUMBER_WORDS.items() if k not in ("no", "eleven", "twelve")} | T.CONTRACTIONS
    cases = " ".join(f"WHEN '{quote(k)}' THEN '{quote(v)}'" for k, v in table.items())
    return f"SELECT question_id, array_to_string([CASE w {cases} ELSE w END for w in {words} if w NOT IN ('a', 'an', 'the', '')], ' ') AS answer FROM (SELECT question_id, {low} AS low FROM q)"


@query(f"""WITH {QUESTIONS_SQL} """ + _plain_sql("answer || CASE WHEN question_id % 2 = 0 THEN ' I dont know whats (new) 3.5.' ELSE ' let''s, youre_no one..' END"))
def p14_plain_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as evaluation compares them."""
    text = F.concat("answer", F.when(F.col("question_id") % 2 == 0, " I dont know whats (new) 3.5.").otherwise(" let's, youre_no one.."))
    return questions(spark, sf_dir).select("question_id", T.plain_answer(text).alias("answer"))


_PROMPTS = ["OCR tokens: a. Question: Is {} red? Short answer:", "Reference OCR token: x\n{} where\nAnswer", "What {}\nReference OCR token: y\nAnswer", "Which {}\nAnswer", "nothing of {}"]
_SAID = ["<think>a</think> <answer> {} </answer>", "{}", "<answer>x</answer>", "<think>b</think>\n<answer>{}</answer>"]


@query("""WITH r AS (SELECT p_partkey, p_name, CASE p_partkey % 5 WHEN 0 THEN 'is ' || lower(p_name) || ' red?' WHEN 1 THEN lower(p_name) || ' where' WHEN 2 THEN 'what ' || lower(p_name) WHEN 3 THEN 'which ' || lower(p_name) END AS question,
      p_partkey % 4 AS k, ['masked_images/GQA/1.png', 'a/vg/2.png', 'masked_results_gqa/3.png', 'c.png'][p_partkey % 4 + 1] AS path FROM part)
    SELECT p_partkey, question, CASE WHEN k IN (0, 1, 3) THEN 1.0::DOUBLE ELSE 0 END AS exact, CASE WHEN k IN (0, 3) THEN 1.0::DOUBLE ELSE 0 END AS format, CASE k WHEN 0 THEN 'gqa' WHEN 1 THEN 'vg' ELSE 'vqa' END AS dataset,
      CASE WHEN k IN (0, 2) THEN 'gqa' WHEN k = 1 THEN 'vg' WHEN p_partkey % 2 = 0 THEN 'vqa' END AS generated_dataset FROM r""")
def p15_prompts_and_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of prompts, rewards of completions, data sets by path."""
    k = F.col("p_partkey")
    pick = lambda texts: F.replace(F.element_at(F.array(*[F.lit(t) for t in texts]), (k % len(texts) + 1).cast("int")), F.lit("{}"), F.col("p_name"))
    path = pick(["masked_images/GQA/1.png", "a/vg/2.png", "masked_results_gqa/3.png", "c.png"])
    return table(spark, sf_dir, "part").select(
        "p_partkey", T.prompt_question(pick(_PROMPTS)).alias("question"), T.exact_reward(pick(_SAID), F.col("p_name")).alias("exact"), T.format_reward(pick(_SAID)).alias("format"),
        T.dataset_of(path, F.lit(True), F.lit(True)).alias("dataset"), T.dataset_of_generated(path, F.when(k % 2 == 1, F.lit("g")), F.col("p_name")).alias("generated_dataset"),
    )


@query(f"""WITH {_SHARE}, q AS (SELECT doc_id, share, doc_id % 10 / 10 AS c, doc_id % 7 / 20 AS m FROM s) SELECT CASE WHEN c >= 0.5 AND m >= 0.15 AND share <= 0.6 THEN 'strong' WHEN c >= 0.2 AND m >= 0.03 AND share <= 0.75 THEN 'partial' ELSE 'weak' END AS quality, count(*) AS n FROM q GROUP BY 1""")
def p16_mask_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks by quality of their match and area."""
    k = F.col("doc_id")
    return _shares(spark, sf_dir).select(T.mask_quality(k % 10 / 10, k % 7 / 20, F.col("share")).alias("quality")).groupBy("quality").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT p_partkey, p_partkey % 3 AS k, [p_name, p_brand, p_type] AS o, CASE WHEN p_partkey % 2 = 0 THEN 'NaN' ELSE 'look' END AS hint FROM part), q AS (SELECT *, CASE k WHEN 0 THEN o WHEN 1 THEN o[:1] ELSE [] END AS kept FROM p), r AS (SELECT *, unnest(range(greatest(1, len(kept)))) AS round FROM q),
    t AS (SELECT *, list_concat(kept[round + 1:], kept[:round]) AS turned FROM r)
    SELECT p_partkey, round::INT AS round, CASE WHEN hint = 'look' THEN 'look' || chr(10) ELSE '' END || 'Which?' || list_reduce(list_concat([''], [chr(10) || substr('ABC', i, 1) || '. ' || x for x, i in turned]), lambda a, b: a || b) AS prompt, array_to_string(turned, '|') AS letters FROM t""")
def p17_prompt_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of a hint, a question and its options, one for each turn of the options."""
    k = F.col("p_partkey")
    options = F.array(F.when(k % 3 == 2, F.lit("None")).otherwise(F.col("p_name")), F.when(k % 3 == 0, F.col("p_brand")), F.col("p_type"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit("Which?").alias("question"), F.when(k % 2 == 0, "NaN").otherwise("look").alias("hint"), options.alias("options"))
    return P.prompt_rounds(rows, "question", "hint", "options").select("p_partkey", "round", "prompt", "letters")


@query("""WITH s AS (SELECT o_orderkey AS c_custkey, nullif(trim(CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE ' ' || o_orderpriority END), '') AS a FROM orders WHERE o_orderkey % 3 > 0)
    SELECT c_custkey, a AS shortcut_answer, false AS strict FROM customer LEFT JOIN s USING (c_custkey) UNION ALL SELECT c_custkey, a, true FROM customer JOIN s USING (c_custkey) WHERE a IS NOT NULL""")
def p18_shortcuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the shortcut answers that are known, all rows and only those that have one."""
    k = F.col("o_orderkey")
    known = table(spark, sf_dir, "orders").filter(k % 3 > 0).select(k.alias("c_custkey"), F.when(k % 4 == 0, " ").otherwise(F.concat(F.lit(" "), F.col("o_orderpriority"))).alias("answer"))
    rows = table(spark, sf_dir, "customer").select("c_custkey")
    parts = [P.with_shortcuts(rows, known, "c_custkey", strict)[0].withColumn("strict", F.lit(strict)) for strict in (False, True)]
    return parts[0].unionByName(parts[1])


@query("""WITH l AS (SELECT DISTINCT CASE o_orderkey % 3 WHEN 0 THEN 'm/' WHEN 1 THEN 'a/' ELSE 'b/' END || o_custkey AS path FROM orders), c AS (SELECT c_custkey, 'm/' || c_custkey IN (FROM l) AS m, 'a/' || c_custkey IN (FROM l) AS a, 'b/' || c_custkey IN (FROM l) AS b FROM customer)
    SELECT c_custkey, CASE WHEN m THEN 'm/' WHEN a THEN 'a/' WHEN b THEN 'b/' END || c_custkey AS image, CASE WHEN m THEN 'masked' WHEN a OR b THEN 'original' END AS image_kind FROM c""")
def p19_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masked image of each row, else an original one, with where it is from."""
    k = F.col("o_orderkey") % 3
    listing = table(spark, sf_dir, "orders").select(F.concat(F.when(k == 0, "m/").when(k == 1, "a/").otherwise("b/"), F.col("o_custkey").cast("string")).alias("path"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", *[F.concat(F.lit(f"{x}/"), F.col("c_custkey").cast("string")).alias(x) for x in "mab"])
    good, bad = P.with_images(rows, "m", ["a", "b"], listing)
    return good.unionByName(bad, allowMissingColumns=True).select("c_custkey", "image", "image_kind")
