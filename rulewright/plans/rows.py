"""Queries that reshape rows: fields under several names, samples of several shapes, submissions, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.functions import text as T
from rulewright.operators import rows as R
from rulewright.plans.catalog import query
from rulewright.plans.texts import QUESTIONS_SQL, questions
from rulewright.sources.tables import table


def _some(every: int, offset: int, value: Column) -> Column:
    return F.when(F.col("question_id") % every == offset, value)


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with their fields under different names, by their id."""
    q, k = questions(spark, sf_dir), F.col("question_id")
    low = F.lower("question")
    return q.select(
        "question_id", "image_id", "answer_type", _some(3, 0, F.col("question")).alias("question"), _some(3, 1, low).alias("generated_question"), F.when(k % 3 == 2, F.concat(F.lit(" "), low)).otherwise("").alias("text"),
        F.when(k % 2 == 0, F.col("answer")).otherwise(" ").alias("answer"), _some(4, 1, F.upper("answer")).alias("generated_answer"), _some(5, 0, F.lit("orig")).alias("original_answer"), _some(7, 0, F.lit("short")).alias("shortcut_answer"),
        F.when(k % 5 == 1, F.lit("p.png")).otherwise("").alias("image_path"), _some(2, 0, F.lit("i.png")).alias("image"),
    )


_MIXED = f"""{QUESTIONS_SQL}, x AS (SELECT question_id AS k, image_id, answer_type, CASE WHEN question_id % 3 = 0 THEN question END AS question, CASE WHEN question_id % 3 = 1 THEN lower(question) END AS gq, CASE WHEN question_id % 3 = 2 THEN ' ' || lower(question) ELSE '' END AS text,
    CASE WHEN question_id % 2 = 0 THEN answer ELSE ' ' END AS answer, CASE WHEN question_id % 4 = 1 THEN upper(answer) END AS ga, CASE WHEN question_id % 5 = 0 THEN 'orig' END AS oa, CASE WHEN question_id % 7 = 0 THEN 'short' END AS sa,
    CASE WHEN question_id % 5 = 1 THEN 'p.png' ELSE '' END AS path, CASE WHEN question_id % 2 = 0 THEN 'i.png' END AS image FROM q)"""
_T = r"regexp_replace({}, '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g')"


@query(f"""WITH {_MIXED} SELECT k AS question_id, {_T.format("coalesce(nullif(gq, ''), nullif(question, ''), nullif(text, ''), '')")} AS question, {_T.format("coalesce(nullif(ga, ''), nullif(answer, ''), nullif(oa, ''), '')")} AS answer, coalesce(nullif(path, ''), image, '') AS image,
    coalesce(answer_type, 'other') AS answer_type, coalesce(nullif({_T.format("question")}, ''), nullif({_T.format("gq")}, ''), nullif({_T.format("text")}, '')) AS asked, coalesce(nullif({_T.format("answer")}, ''), nullif({_T.format("ga")}, '')) AS correct_answer, coalesce(sa, oa, '') AS shortcut_answer FROM x""")
def o1_aliased_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of rows by the names that they have, in two orders."""
    rows = _mixed(spark, sf_dir)
    own = R.evaluation_fields(F.lit("x"))
    return rows.select("question_id", *R.aliased_fields(), own[0].alias("asked"), own[2], own[3])


@query(f"""WITH {QUESTIONS_SQL} SELECT question_id, {_T.format("question")} AS question, {_T.format("answer")} AS answer, coalesce(answer_type, 'other') AS answer_type, printf('COCO_train2014_%012d.jpg', image_id) AS image, '<image>' || chr(10) || question AS text,
    CASE WHEN answer = '' THEN '' ELSE upper({_T.format("answer")}[1]) || {_T.format("answer")}[2:] END AS capital, CASE WHEN regexp_replace(replace({_T.format("question")}, ' ', '_'), '[^0-9a-zA-Z_-]+', '_', 'g') = '' THEN 'empty' ELSE regexp_replace(replace({_T.format("question")}, ' ', '_'), '[^0-9a-zA-Z_-]+', '_', 'g')[:20] END AS stem FROM q""")
def o2_question_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training fields, evaluation rows, capital letters and file stems of questions."""
    q = questions(spark, sf_dir)
    marked = R.question_row(marked=True)
    return q.select(*[c for c in R.training_fields()][:2], R.training_fields()[3], R.training_fields()[4], marked[1], marked[2], R.capitalised(F.col("answer")).alias("capital"), R.file_stem(F.col("question"), 20).alias("stem"))


_PAIRS = f"""{QUESTIONS_SQL}, p AS (SELECT question_id, image_id, CASE WHEN question_id % 6 = 1 THEN ' ' ELSE question END AS question, trim(CASE question_id % 4 WHEN 0 THEN upper(answer) WHEN 1 THEN 'new' ELSE answer END) AS made, trim(answer) AS original, CASE WHEN question_id % 2 = 0 THEN 'x.jpg' END AS img, row_number() OVER (ORDER BY question_id) - 1 AS idx FROM q)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("question_id")
    return questions(spark, sf_dir).select(
        "question_id", "image_id", F.when(k % 6 == 1, " ").otherwise(F.col("question")).alias("original_question"), F.when(k % 4 == 0, F.upper("answer")).when(k % 4 == 1, "new").otherwise(F.col("answer")).alias("generated_answer"), F.col("answer").alias("original_answer"),
        F.when(k % 2 == 0, "x.jpg").alias("source_image"), "answer_type",
    )


@query(f"WITH {_PAIRS} SELECT idx, question_id, coalesce(img, printf('COCO_train2014_%012d.jpg', image_id)) AS image, {_T.format('question')} AS question, made AS chosen, original AS rejected FROM p WHERE trim(question) <> '' AND made <> '' AND original <> '' AND lower(made) <> lower(original)")
def o3_preference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs that differ in more than case, with their place among all rows."""
    rows = R.preference_rows(_pairs(spark, sf_dir), "original_question", "question_id")
    return rows.select("idx", "question_id", "image", "question", F.col("positive.answer").alias("chosen"), F.col("negative.answer").alias("rejected"))


@query(f"WITH {_PAIRS} SELECT row_number() OVER (ORDER BY question_id) - 1 AS idx, question_id, 'root/' || coalesce(img, 'y.jpg') AS image_path, made AS chosen, original AS rejected, 'train' AS origin_split FROM p WHERE trim(question) <> '' AND made <> '' AND original <> '' AND made <> original")
def o4_preference_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs that differ in any letter, numbered anew."""
    rows = _pairs(spark, sf_dir).select("question_id", "image_id", F.col("original_question").alias("question"), F.col("generated_answer").alias("chosen"), F.col("original_answer").alias("rejected"), "answer_type", F.coalesce("source_image", F.lit("y.jpg")).alias("image"), F.lit(None).cast("string").alias("origin_split"))
    return R.preference_records(rows, "root/", "question_id").select("idx", "question_id", "image_path", "chosen", "rejected", "origin_split")


@query(f"""WITH {QUESTIONS_SQL}, s AS (SELECT *, question_id % 4 AS k FROM q)
    SELECT question_id, CASE k WHEN 0 THEN printf('COCO_train2014_%012d.jpg', image_id) WHEN 1 THEN printf('COCO_train2014_%012d.jpg', image_id) WHEN 2 THEN 'gqa/images/' || image_id || '.jpg' END AS image, CASE k WHEN 1 THEN 'vqa' WHEN 2 THEN 'gqa' END AS data_source,
      CASE k WHEN 0 THEN 'kept' WHEN 3 THEN NULL ELSE '<image>' || chr(10) || {_T.format("question")} END AS asked, CASE WHEN k = 1 THEN {_T.format("answer")} WHEN k = 2 THEN upper({_T.format("answer")}) END AS answered,
      CASE k WHEN 0 THEN 'ready' WHEN 1 THEN '<image>' || chr(10) || question WHEN 2 THEN '<image>' || chr(10) || question END AS prompt, CASE k WHEN 0 THEN 'c' WHEN 1 THEN answer WHEN 2 THEN 'c' END AS chosen, CASE k WHEN 0 THEN 'r' WHEN 1 THEN 's' WHEN 2 THEN 'r' END AS rejected FROM s""")
def o5_samples_of_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training and preference samples from rows of three shapes and of none."""
    k = F.col("question_id") % 4
    turn = lambda who, text: F.struct(F.lit(who).alias("from"), text.alias("value"))
    q = questions(spark, sf_dir)
    rows = q.select(
        "question_id", "image_id", "answer_type", F.when(k == 0, F.array(turn("human", F.lit("kept")))).alias("conversations"), F.when(k == 1, F.col("question")).alias("question"), F.when(k == 1, F.col("answer")).alias("answer"),
        F.when(k == 2, F.col("question")).alias("generated_question"), F.when(k == 2, F.upper("answer")).alias("generated_answer"), *[F.lit(None).cast("string").alias(c) for c in ("image", "image_path", "data_source", "mask_supervision")],
    )
    sample = rows.select("question_id", R.multimodal_sample(F.when(k == 2, "gqa")).alias("s"))
    pairs = q.select(
        "question_id", "image_id", F.when(k == 0, "ready").alias("prompt"), F.when(k.isin(0, 2), "c").alias("chosen"), F.when(k.isin(0, 2), "r").alias("rejected"), F.when(k.isin(1, 2), F.col("question")).alias("question"),
        F.when(k == 1, F.col("answer")).alias("answer"), F.when(k == 1, "s").alias("shortcut_answer"), F.lit(None).cast("string").alias("image"),
    ).select("question_id", R.preference_sample().alias("p"))
    turns = F.col("s.conversations")
    return sample.join(pairs, "question_id").select("question_id", "s.image", "s.data_source", F.get(turns, F.lit(0))["value"].alias("asked"), F.get(turns, F.lit(1))["value"].alias("answered"), "p.prompt", "p.chosen", "p.rejected")


@query("""SELECT conv_id, turn, CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' ELSE role END AS role, chr(10) || chr(10) || '$[img]' || chr(10) || chr(10) || text AS content FROM conversations""")
def o6_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as messages with another image mark."""
    who = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    turn = F.array(F.struct(who.alias("from"), F.concat(F.lit("\n<image>\n"), F.col("text")).alias("value")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(R.messages(turn, "$[img]")).alias("m"))
    return rows.select("conv_id", "turn", "m.role", "m.content")


@query(f"""WITH {QUESTIONS_SQL}, p AS (SELECT question_id, answer || '..' AS text FROM q WHERE question_id % 3 <> 0) SELECT 'judged' AS form, question_id::VARCHAR AS key, CASE WHEN p.text = '..' THEN '..' ELSE upper({_T.format("p.text")}[1]) || {_T.format("p.text")}[2:] END AS text FROM p JOIN q USING (question_id) WHERE question_id % 5 <> 0
    UNION ALL SELECT 'unjudged', question_id::VARCHAR, NULL FROM p WHERE question_id % 5 = 0
    UNION ALL SELECT 'prediction', question_id::VARCHAR, lower(regexp_replace(text, '\\.+$', '')) FROM p UNION ALL SELECT 'mapped', 'v1_' || question_id, text FROM p UNION ALL SELECT 'all', question_id::VARCHAR, CASE WHEN question_id % 3 = 0 THEN '' ELSE 'x' END FROM q""")
def o7_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions in the forms that evaluations take."""
    q = questions(spark, sf_dir)
    p = q.filter("question_id % 3 <> 0").select("question_id", "question", F.concat("answer", F.lit("..")).alias("text"))
    good, bad = R.judge_rows(p, q.filter("question_id % 5 <> 0"))
    key = F.col("question_id").cast("string")
    parts = [
        good.select(F.lit("judged").alias("form"), key.alias("key"), F.col("llm_output").alias("text")), bad.select(F.lit("unjudged").alias("form"), key.alias("key"), F.lit(None).cast("string").alias("text")),
        R.prediction_submission(p).select(F.lit("prediction").alias("form"), F.col("questionId").cast("string").alias("key"), F.col("prediction").alias("text")), R.mapped_submission(p).select(F.lit("mapped").alias("form"), "key", "text"),
        R.answer_submission(q, p.withColumn("text", F.lit("X."))).select(F.lit("all").alias("form"), key.alias("key"), F.col("answer").alias("text")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


_ALIASES, _EXCLUDED = {"ring": ["bolt", "c++"], "widget": ["gear"]}, {"ring": ["small ring"]}


@query("""WITH t AS (SELECT p_partkey, lower('A ' || p_name || ' of C++, rings') AS text, p_partkey % 3 AS k FROM part),
    c AS (SELECT *, unnest(['ring', 'Widget', 'gear']) AS cue FROM t),
    d AS (SELECT *, CASE WHEN cue = 'ring' AND contains(text, 'small ring') THEN NULL WHEN regexp_matches(text, '(^|[^a-z])' || lower(cue) || '([^a-z]|$)') THEN 'strict_literal_match:' || lower(cue)
      WHEN cue = 'ring' AND regexp_matches(text, '(^|[^a-z])bolt([^a-z]|$)') THEN 'strict_alias_match:bolt' WHEN cue = 'ring' THEN 'strict_alias_match:c++' WHEN cue = 'Widget' AND regexp_matches(text, '(^|[^a-z])gear([^a-z]|$)') THEN 'strict_alias_match:gear' END AS strict FROM c),
    e AS (SELECT *, coalesce(strict, CASE WHEN cue = 'gear' AND k > 0 THEN 'seen' ELSE 'missing_from_model_output' END) AS reason, strict IS NOT NULL OR (cue = 'gear' AND k = 1) AS mentioned FROM d)
    SELECT p_partkey, string_agg(cue || '=' || mentioned || ':' || reason, '|' ORDER BY CASE cue WHEN 'ring' THEN 0 WHEN 'Widget' THEN 1 ELSE 2 END) AS cues, bool_or(mentioned) AS remove FROM e GROUP BY p_partkey""")
def o8_audited_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which cues a text mentions, strictly or by what a model said."""
    k = F.col("p_partkey") % 3
    one = F.struct(F.lit(" gear ").alias("cue"), (k == 1).alias("mentioned"), F.lit(" seen").alias("reason"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("A "), F.col("p_name"), F.lit(" of C++, rings")).alias("text"), F.array(F.lit("ring"), F.lit("Widget"), F.lit("gear")).alias("visual_cues"), F.when(k > 0, F.array(one)).otherwise(F.array().cast("array<struct<cue:string,mentioned:boolean,reason:string>>")).alias("said"))
    told = R.audited(rows, _ALIASES, _EXCLUDED)
    return told.select("p_partkey", F.array_join(F.transform("cue_results", lambda c: F.concat(c["cue"], F.lit("="), c["mentioned"].cast("string"), F.lit(":"), c["reason"])), "|").alias("cues"), "remove")


@query("""SELECT event_id, (props->>'k')::DOUBLE AS "Valid_num", NULL::DOUBLE AS "Correct_num", NULL::DOUBLE AS "Incorrect_num", CASE WHEN event_id % 2 = 0 THEN 0.5 END::DOUBLE AS "Accuracy" FROM events""")
def o9_metric_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and accuracy in a judge's statistics."""
    inner = F.concat(F.lit('{"stat_info": {"Valid_num": '), F.get_json_object("props", "$.k"), F.when(F.col("event_id") % 2 == 0, F.lit(', "Accuracy": 0.5')).otherwise(F.lit("")), F.lit("}}"))
    return table(spark, sf_dir, "events").select("event_id", *R.metric_fields(F.parse_json(inner)))
