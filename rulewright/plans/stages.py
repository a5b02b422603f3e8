"""Queries from matched rules to training rows; parts stand for questions, suppliers for rules, events for responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.operators import stages as S
from rulewright.plans.catalog import query
from rulewright.plans.texts import QUESTIONS_SQL, questions
from rulewright.sources.tables import table

def _k() -> Column:
    return F.col("p_partkey")


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.when(_k() % 4 == 0, F.lit("0")).when(_k() % 9 != 5, (_k() % 120).cast("string"))
    return table(spark, sf_dir, "part").select(_k().alias("question_id"), F.when(_k() % 10 != 3, _k() % 100).alias("image_id"), rule.alias("rule_id"))


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    words = F.when(k % 5 == 0, F.array(F.lit(" "))).otherwise(F.array(F.concat(F.lit(" k"), (k % 7).cast("string")), F.lit("")))
    cues = F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("c"), (k % 4).cast("string"))))
    return table(spark, sf_dir, "supplier").select(k.cast("string").alias("rule_id"), words.alias("text_keywords"), cues.alias("visual_cues"), F.concat(F.lit(" "), F.col("s_name")).alias("answer"))


def _annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(_k() % 3 == 0).select(_k().alias("question_id"), F.lit("Number").alias("answer_type"))


_TABLES = f"""{QUESTIONS_SQL},
    m AS (SELECT p_partkey AS question_id, CASE WHEN p_partkey % 10 <> 3 THEN p_partkey % 100 END AS image_id, CASE WHEN p_partkey % 4 = 0 THEN '0' WHEN p_partkey % 9 <> 5 THEN (p_partkey % 120)::VARCHAR END AS rule_id FROM part),
    r AS (SELECT s_suppkey::VARCHAR AS rule_id, CASE WHEN s_suppkey % 5 = 0 THEN [' '] ELSE [' k' || s_suppkey % 7, ''] END AS words, CASE WHEN s_suppkey % 3 = 0 THEN []::VARCHAR[] ELSE ['c' || s_suppkey % 4] END AS cues, ' ' || s_name AS answer FROM supplier),
    n AS (SELECT p_partkey AS question_id, 'Number' AS answer_type FROM part WHERE p_partkey % 3 = 0),
    j AS (SELECT m.question_id, coalesce(m.image_id, q.image_id) AS image_id, coalesce(r.words, []) AS words, coalesce(r.cues, []) AS cues, coalesce(r.answer, '') AS answer,
          lower(coalesce(nullif(trim(q.answer_type), ''), nullif(trim(n.answer_type), ''), 'unknown')) AS answer_type, r.rule_id IS NOT NULL AND coalesce(m.rule_id, '0') <> '0' AS matched, m.rule_id
          FROM m LEFT JOIN r ON r.rule_id = coalesce(m.rule_id, '0') LEFT JOIN q USING (question_id) LEFT JOIN n USING (question_id))"""


def _merged(spark: SparkSession, sf_dir: str, unmatched: bool) -> DataFrame:
    return S.merged_matches(_matches(spark, sf_dir), _rules(spark, sf_dir), questions(spark, sf_dir), _annotations(spark, sf_dir), unmatched)


def _flat(rows: DataFrame, **named: Column) -> DataFrame:
    return rows.withColumns({c: F.array_join(c, "|") for c in ("text_keywords", "visual_cues")} | named)


@query(f"WITH {_TABLES} SELECT question_id, image_id, array_to_string(words, '|') AS text_keywords, array_to_string(cues, '|') AS visual_cues, answer, answer_type FROM j WHERE matched")
def n1_merged_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with their rules, questions and types."""
    return _flat(_merged(spark, sf_dir, False))


@query(f"WITH {_TABLES} SELECT question_id, image_id, array_to_string(words, '|') AS text_keywords, array_to_string(cues, '|') AS visual_cues, answer, answer_type FROM j")
def n2_merged_with_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the questions that no rule matched."""
    return _flat(_merged(spark, sf_dir, True))


@query(f"WITH {_TABLES} SELECT q.question_id, question, CASE WHEN matched THEN j.rule_id END AS rule_id, CASE WHEN matched THEN array_to_string(cues, '|') END AS cues, matched FROM q JOIN j USING (question_id)")
def n3_matched_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions with their rule as a struct."""
    rows = S.matched_questions(questions(spark, sf_dir), _matches(spark, sf_dir), _rules(spark, sf_dir))
    return rows.select("question_id", "question", F.col("rule.rule_id").alias("rule_id"), F.array_join("rule.visual_cues", "|").alias("cues"), "matched")


_CANDIDATES = f"""WITH {_TABLES}, c AS (SELECT j.question_id, j.image_id, trim(q.question) AS question, q.question_id IS NOT NULL AS known, list_filter(list_transform(words, lambda w: trim(w)), lambda w: w <> '') AS words, cues, trim(j.answer) AS answer, j.answer_type
        FROM j LEFT JOIN (SELECT * FROM q WHERE question_id % 11 <> 0) q USING (question_id)),
    d AS (SELECT *, CASE WHEN len(words) = 0 AND len(cues) = 0 THEN 'no keywords and cues' WHEN len(words) = 0 THEN 'no keywords' WHEN len(cues) = 0 THEN 'no cues' WHEN NOT known THEN 'no question' END AS reason FROM c)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.candidate_rows(_merged(spark, sf_dir, True), questions(spark, sf_dir).filter("question_id % 11 <> 0"))


@query(_CANDIDATES + """ SELECT question_id, image_id, question, printf('COCO_train2014_%012d.jpg', image_id) AS image, array_to_string(words, '|') AS text_keywords, array_to_string(cues, '|') AS visual_cues, answer, answer_type FROM d WHERE reason IS NULL""")
def n4_stage_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that go on to generation: keywords, cues and a known question."""
    return _flat(S.stage_inputs(_candidates(spark, sf_dir))[0])


@query(_CANDIDATES + " SELECT question_id, image_id, printf('COCO_train2014_%012d.jpg', image_id) AS image, question AS text FROM d WHERE reason IS NULL")
def n5_stage_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their questions alone."""
    return S.stage_inputs(_candidates(spark, sf_dir))[1]


@query(_CANDIDATES + """ SELECT count(*) AS total, count(*) FILTER (reason IS NULL) AS selected, count(*) FILTER (reason IN ('no keywords and cues', 'no keywords', 'no cues')) AS ineligible,
    count(*) FILTER (reason IN ('no keywords and cues', 'no keywords')) AS without_keywords, count(*) FILTER (reason IN ('no keywords and cues', 'no cues')) AS without_cues, count(*) FILTER (reason = 'no question') AS without_question FROM d""")
def n6_stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows are skipped, and why."""
    return S.skip_counts(_candidates(spark, sf_dir))


_SAID = ['{"question": " What is {}? ", "answer": "a{}"}', "[1, {}]", "no json {}", '{"question": " ", "answer": "{}"}', '{"question": "Where is {}?"}', '{"question": "Who?", "answer": {}}']


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id").cast("string")
    said = F.replace(F.element_at(F.array(*[F.lit(t) for t in _SAID]), (e % len(_SAID) + 1).cast("int")), F.lit("{}"), e.cast("string"))
    custom = F.when(e % 13 == 0, F.lit("stage-")).when(e % 17 != 0, F.concat(F.lit("stage-2-"), F.when(e % 7 == 0, F.lit("x")).otherwise(F.lit("")), u))
    return table(spark, sf_dir, "events").select(
        e.alias("ord"), custom.alias("custom_id"), F.when(e % 11 != 0, F.when(e % 5 == 0, 500).otherwise(200)).alias("status_code"), F.col("event_type").alias("model"), said.alias("output_text"), F.concat(F.lit("r"), e.cast("string")).alias("response_id")
    )


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.judged_responses(_responses(spark, sf_dir), S.stage_inputs(S.candidate_rows(_merged(spark, sf_dir, True), questions(spark, sf_dir)))[0])


_JUDGED = f"""WITH {_TABLES}, s AS (SELECT j.question_id, j.image_id, trim(q.question) AS question, list_filter(list_transform(words, lambda w: trim(w)), lambda w: w <> '') AS words, cues, trim(j.answer) AS answer, j.answer_type FROM j JOIN q USING (question_id)),
    src AS (SELECT * FROM s WHERE len(words) > 0 AND len(cues) > 0),
    e AS (SELECT event_id AS ord, CASE WHEN event_id % 13 = 0 THEN 'stage-' WHEN event_id % 17 <> 0 THEN 'stage-2-' || CASE WHEN event_id % 7 = 0 THEN 'x' ELSE '' END || user_id END AS custom_id,
          CASE WHEN event_id % 11 <> 0 THEN CASE WHEN event_id % 5 = 0 THEN 500 ELSE 200 END END AS status_code, event_type AS model,
          replace([{", ".join("'" + t + "'" for t in _SAID)}][event_id % {len(_SAID)} + 1], '{{}}', event_id::VARCHAR) AS said FROM events),
    k AS (SELECT *, CASE WHEN custom_id IS NULL THEN '' ELSE regexp_extract(custom_id, '[^-]*$') END AS source_key, CASE WHEN json_valid(said) AND json_type(CASE WHEN json_valid(said) THEN said END) = 'OBJECT' THEN said::JSON END AS obj FROM e),
    g AS (SELECT k.*, src.question_id, coalesce(trim(obj->>'question'), '') AS gq, coalesce(trim(obj->>'answer'), '') AS ga FROM k LEFT JOIN src ON src.question_id::VARCHAR = source_key),
    h AS (SELECT *, CASE WHEN status_code IS DISTINCT FROM 200 THEN 'status' WHEN source_key = '' THEN 'custom_id' WHEN question_id IS NULL THEN 'source' WHEN obj IS NULL THEN 'json' WHEN gq = '' THEN 'question' WHEN ga = '' THEN 'answer' END AS reason FROM g),
    w AS (SELECT * REPLACE (CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY source_key, reason IS NULL ORDER BY ord) > 1 THEN 'repeated' ELSE reason END AS reason) FROM h)"""


@query(_JUDGED + " SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM w GROUP BY 1")
def n7_response_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why responses are skipped."""
    return S.reason_counts(_judged(spark, sf_dir))


@query(_JUDGED + """ SELECT src.question_id, gq AS question, src.image_id, ga AS answer, src.answer_type, src.question AS original_question, src.answer AS original_answer, gq AS generated_question, ga AS generated_answer,
    array_to_string(words, '|') AS text_keywords, array_to_string(cues, '|') AS visual_cues, printf('COCO_train2014_%012d.jpg', src.image_id) AS source_image, model AS source_model, custom_id AS source_custom_id, 'r' || ord AS source_response_id
    FROM w JOIN src USING (question_id) WHERE reason IS NULL""")
def n8_generated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training rows of the responses that stay."""
    return _flat(S.generated_rows(_judged(spark, sf_dir)))


_FENCED = ["```json\n{\"k\": {}}\n```", "So: {\"k\": {}} as asked", "{\"k\": \"{}\"}", "[{\"k\": {}}]", "nothing {", "``` {\"k\": {}}```"]


@query(f"""WITH t AS (SELECT event_id, replace([{", ".join("'" + t.replace(chr(10), "' || chr(10) || '") + "'" for t in _FENCED)}][event_id % {len(_FENCED)} + 1], '{{}}', event_id::VARCHAR) AS said FROM events)
    SELECT event_id, CASE WHEN event_id % {len(_FENCED)} <> 4 THEN event_id::VARCHAR END AS k, event_id % {len(_FENCED)} IN (2) AS strict, 'a' || event_id || chr(10) || 'b' AS said,
      'data:' || CASE event_id % 3 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' ELSE 'image/webp' END || ';base64,' || to_base64(event_type::BLOB) AS url,
      'Use ' || CASE WHEN event_id % 2 = 0 THEN '(no keywords)' ELSE event_type || ', x' END || ' for ' || CASE WHEN event_id % 3 = 0 THEN '(empty)' ELSE 'a' END || ' as (unknown).' AS prompt FROM t JOIN events USING (event_id)""")
def n9_model_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of model texts, texts of response payloads, data URLs and prompts."""
    e = F.col("event_id")
    said = F.replace(F.element_at(F.array(*[F.lit(t) for t in _FENCED]), (e % len(_FENCED) + 1).cast("int")), F.lit("{}"), e.cast("string"))
    payload = F.format_string('{"output": [{"type": "reasoning"}, {"type": "message", "content": [{"type": "output_text", "text": "a%d"}, {"type": "refusal", "text": "x"}, {"type": "text", "text": "b"}, {"type": "text", "text": ""}]}]}', e)
    name = F.concat(F.lit("a/b.c"), F.element_at(F.array(F.lit(".JPG"), F.lit(""), F.lit(".webp")), (e % 3 + 1).cast("int")))
    words = F.when(e % 2 == 1, F.array("event_type", F.lit("x")))
    rows = table(spark, sf_dir, "events")
    return rows.select(
        "event_id", F.try_variant_get(S.lenient_object(said), "$.k", "string").alias("k"), S.model_object(said).isNotNull().alias("strict"), S.response_text(payload).alias("said"),
        S.data_url(name, F.col("event_type").cast("binary")).alias("url"), S.keyword_prompt("Use {keywords} for {original_answer} as {answer_type}.", words, F.when(e % 3 != 0, F.lit("a")), F.lit("")).alias("prompt"),
    )


_CHATS = [
    '{"choices": [{"message": {"content": " a# "}}], "output": [{"content": [{"type": "text", "text": "no"}]}]}', '{"choices": [{"message": {"content": [{"type": "text", "text": "a#"}, {"type": "image", "text": "x"}, {"type": "text", "text": ""}, {"type": "text", "text": "b "}]}}]}',
    '{"choices": [], "output": [{"content": [{"type": "output_text", "text": "a#"}, {"type": "refusal", "text": "x"}]}, {"type": "reasoning"}, {"content": [{"type": "text", "text": "c"}]}]}', '{"error": "#"}', '{"choices": [{"index": #}]}', "no JSON #",
]


@query(f"SELECT event_id, CASE event_id % {len(_CHATS)} WHEN 0 THEN 'a' || event_id WHEN 1 THEN 'a' || event_id || chr(10) || 'b' WHEN 2 THEN 'a' || event_id || chr(10) || 'c' WHEN 4 THEN '' END AS said FROM events")
def n17_chat_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of payloads of choices and of outputs."""
    e = F.col("event_id")
    payload = F.replace(F.element_at(F.array(*[F.lit(t) for t in _CHATS]), (e % len(_CHATS) + 1).cast("int")), F.lit("#"), e.cast("string"))
    return table(spark, sf_dir, "events").select("event_id", S.chat_text(payload).alias("said"))


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS ord, c_custkey AS id, c_name AS x FROM customer), b AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS ord, s_suppkey + CASE WHEN s_suppkey % 9 = 4 THEN 1 ELSE 0 END AS id, s_name AS y FROM supplier)
    SELECT ord, CASE WHEN a.id IS NULL OR b.id IS NULL THEN 'only one side' WHEN a.id <> b.id THEN 'other key' ELSE x || y END AS outcome FROM a FULL JOIN b USING (ord)""")
def n10_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables joined by place, with the places that don't fit."""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_custkey").alias("id"), F.col("c_name").alias("x"))
    k = F.col("s_suppkey")
    b = table(spark, sf_dir, "supplier").select(k.alias("ord"), (k + F.when(k % 9 == 4, 1).otherwise(0)).alias("id"), F.col("s_name").alias("y"))
    good, bad = S.positional(a, b, "ord", "id")
    return good.select("ord", F.concat("x", "right_y").alias("outcome")).unionByName(bad.select("ord", F.col("problem").alias("outcome")))


@query("""WITH a AS (SELECT o_custkey AS id FROM orders WHERE o_custkey % 7 <> 2), b AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 5 <> 1),
    n AS (SELECT id, x.l, y.r FROM (SELECT id, count(*) AS l FROM a GROUP BY 1) x FULL JOIN (SELECT id, count(*) AS r FROM b GROUP BY 1) y USING (id)), m AS (SELECT id, CASE WHEN l IS NULL THEN 'missing left' WHEN r IS NULL THEN 'missing right' WHEN l > 1 OR r > 1 THEN 'repeated' END AS problem FROM n)
    SELECT problem, count(*) AS n FROM m WHERE problem IS NOT NULL GROUP BY 1 UNION ALL SELECT 'joined', count(*) FROM a JOIN b USING (id)""")
def n11_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables joined by key, with the keys that are missing or repeated."""
    a = table(spark, sf_dir, "orders").filter("o_custkey % 7 <> 2").select(F.col("o_custkey").alias("id"))
    b = table(spark, sf_dir, "customer").filter("c_custkey % 5 <> 1").select(F.col("c_custkey").alias("id"))
    rows, bad = S.keyed(a, b, "id")
    return bad.groupBy("problem").agg(F.count(F.lit(1)).alias("n")).unionByName(rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit("joined").alias("problem"), "n"))


@query(f"""WITH {QUESTIONS_SQL}, a AS (SELECT question_id, image_id, answer_type, question, answer FROM q WHERE question_id % 7 <> 1), b AS (SELECT question_id, CASE WHEN question_id % 5 = 0 THEN image_id + 1 ELSE image_id END AS image_id, CASE WHEN question_id % 3 = 0 THEN 'number' ELSE answer_type END AS answer_type, upper(question) AS question, answer FROM q WHERE question_id % 11 <> 2),
    s AS (SELECT i.question_id, CASE WHEN a.question_id IS NULL THEN 'missing original' WHEN b.question_id IS NULL THEN 'missing other' WHEN a.image_id <> b.image_id THEN 'image differs' WHEN a.answer_type IS DISTINCT FROM b.answer_type THEN 'type differs' ELSE 'kept' END AS status,
      a.image_id, coalesce(nullif(b.answer_type, ''), nullif(a.answer_type, ''), 'unknown') AS answer_type, a.question AS original, b.question AS other FROM (SELECT DISTINCT l_partkey AS question_id FROM lineitem) i LEFT JOIN a USING (question_id) LEFT JOIN b USING (question_id))
    SELECT question_id, status, CASE WHEN status IN ('kept', 'type differs') THEN image_id END AS image_id, CASE WHEN status IN ('kept', 'type differs') THEN answer_type END AS answer_type, CASE WHEN status IN ('kept', 'type differs') THEN original END AS original, CASE WHEN status IN ('kept', 'type differs') THEN other END AS other FROM s""")
def n12_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen questions with an original and a counter-example, and why some don't stay."""
    q, k = questions(spark, sf_dir), F.col("question_id")
    others = q.filter(k % 11 != 2).select("question_id", F.when(k % 5 == 0, F.col("image_id") + 1).otherwise(F.col("image_id")).alias("image_id"), F.when(k % 3 == 0, "number").otherwise(F.col("answer_type")).alias("answer_type"), F.upper("question").alias("question"), "answer")
    rows = S.three_way(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("question_id")), q.filter(k % 7 != 1), others)
    return rows.select("question_id", "status", "image_id", "answer_type", F.col("original.question").alias("original"), F.col("anti_shortcut.question").alias("other"))


@query(f"""WITH {_TABLES}, p AS (SELECT c_custkey AS image_id, 'a/' || c_custkey AS path FROM customer WHERE c_custkey % 2 = 0), o AS (SELECT c_custkey AS image_id, 'b/' || c_custkey AS path FROM customer WHERE c_custkey % 3 = 0)
    SELECT m.question_id, m.image_id, array_to_string(cues, '|') AS cues, coalesce(p.path, o.path) AS path FROM m JOIN r USING (rule_id) LEFT JOIN p USING (image_id) LEFT JOIN o USING (image_id) WHERE len(cues) > 0 AND coalesce(p.path, o.path) IS NOT NULL""")
def n13_cue_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with cues whose image is in one of two listings."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("image_id"))
    listed = [c.filter(f"image_id % {n} = 0").select("image_id", F.concat(F.lit(f"{x}/"), F.col("image_id").cast("string")).alias("path")) for n, x in ((2, "a"), (3, "b"))]
    return S.cue_sources(_matches(spark, sf_dir), _rules(spark, sf_dir), listed).select("question_id", "image_id", F.array_join("visual_cues", "|").alias("cues"), "path")


@query("""WITH p AS (SELECT p_partkey AS problem_id, p_partkey % 3 AS answer, 3 AS choices FROM part), a AS (SELECT problem_id, substr('ABCDE', (problem_id // 2 % 4 + 1)::INT, 1) AS letter FROM p WHERE problem_id % 7 <> 0),
    b AS (SELECT problem_id, CASE WHEN problem_id % 4 = 0 THEN 'FAILED' ELSE substr('ABCDE', (problem_id // 3 % 3 + 1)::INT, 1) END AS letter FROM p WHERE problem_id % 5 <> 0),
    j AS (SELECT problem_id, answer, strpos('ABC', a.letter) - 1 AS x, b.letter = 'FAILED' AS failed, strpos('ABC', b.letter) - 1 AS y FROM p JOIN a USING (problem_id) JOIN b USING (problem_id))
    SELECT problem_id, CASE WHEN failed THEN x = answer ELSE y = answer END AS correct, x = answer OR (NOT failed AND y = answer) AS upper, failed FROM j""")
def n14_ensembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two predictors combined, with the upper bound."""
    k = F.col("problem_id")
    p = table(spark, sf_dir, "part").select(_k().alias("problem_id"), (_k() % 3).alias("answer"), F.lit(3).alias("choices"))
    said = lambda letter: F.concat(F.lit("So. The answer is "), letter, F.lit("."))
    letter = lambda at: F.element_at(F.array(*[F.lit(x) for x in "ABCDE"]), (at + 1).cast("int"))
    own = p.filter(k % 7 != 0).select("problem_id", said(letter(F.floor(k / 2) % 4)).alias("text"))
    other = p.filter(k % 5 != 0).select("problem_id", F.when(k % 4 == 0, "The answer is unclear").otherwise(said(letter(F.floor(k / 3) % 3))).alias("text"))
    return S.ensembled(p, own, other, list("ABCDE"))


@query("""WITH q AS (SELECT p_partkey AS id, p_type AS kind, substr('ABCD', (p_partkey % 4 + 1)::INT, 1) AS answer FROM part), p AS (SELECT id, substr('ABCD', (id // 4 % 4 + 1)::INT, 1) AS text FROM q WHERE id % 6 <> 0)
    SELECT kind, count(*) AS n, count(*) FILTER (text = answer) AS correct, count(*) FILTER (text IS NULL) AS failed FROM q LEFT JOIN p USING (id) GROUP BY kind""")
def n15_answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with predictions, those without counted as wrong."""
    letter = lambda at: F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), (at % 4 + 1).cast("int"))
    q = table(spark, sf_dir, "part").select(_k().alias("id"), F.col("p_type").alias("kind"), letter(_k()).alias("answer"))
    rows = S.answered(q, q.filter("id % 6 <> 0").select("id", letter(F.floor(F.col("id") / 4)).alias("text")), "id")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("correct"), 1)).alias("correct"), F.count(F.when(F.col("predicted") == "FAILED", 1)).alias("failed"))


@query("""SELECT p_partkey AS ord, p_brand AS image, p_type AS category, lower(p_name) AS first, upper(p_name) AS second, 'about ' || p_brand AS context, 'rule ' || p_type AS rule FROM part WHERE p_type <> 'PROMO' AND p_brand <> 'Brand#7'
    UNION ALL SELECT NULL, NULL, 'PROMO', NULL, NULL, NULL, NULL WHERE EXISTS (FROM part WHERE p_type = 'PROMO' AND p_brand <> 'Brand#7')""")
def n16_reviewed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with two answers, context and rule, and the categories that lack a rule."""
    part = table(spark, sf_dir, "part")
    q = part.select(_k().alias("ord"), F.col("p_brand").alias("image"), F.col("p_type").alias("category"))
    side = lambda f: part.select(_k().alias("ord"), f("p_name").alias("text"))
    contexts = part.filter("p_brand <> 'Brand#7'").select(F.col("p_brand").alias("image"), F.concat(F.lit("about "), F.col("p_brand")).alias("context")).distinct()
    rules = part.filter("p_type <> 'PROMO'").select(F.col("p_type").alias("category"), F.concat(F.lit("rule "), F.col("p_type")).alias("rule")).distinct()
    rows, bad = S.reviewed_pairs(q, side(F.lower), side(F.upper), contexts, rules)
    return rows.unionByName(bad, allowMissingColumns=True)
