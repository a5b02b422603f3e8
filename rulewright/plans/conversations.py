"""Queries over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.functions import text as T
from rulewright.operators import conversations as C
from rulewright.plans.catalog import query
from rulewright.plans.texts import _STUMP, _quoted
from rulewright.sources.tables import table

_PAIRS = f"""o AS (SELECT conv_id, row_number() OVER w - 1 AS pos, role, text AS question, lead(role) OVER w AS r2, lead(text) OVER w AS answer,
      bool_or(regexp_matches(lower(text), '{T.IMAGE_PATTERN}')) OVER (PARTITION BY conv_id) AS mentions_image FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    p AS (SELECT conv_id, (pos // 2)::INT AS pair, question, answer, mentions_image FROM o WHERE pos % 2 = 0 AND role = 'user' AND r2 = 'assistant')"""


@query(f"WITH {_PAIRS} SELECT * FROM p")
def w1_turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-turn conversations as question and answer pairs."""
    return C.turn_pairs(table(spark, sf_dir, "conversations"))


_WS = r"[ \t\n\x0b\f\r]"


@query(f"""WITH {_PAIRS}, r AS (SELECT *, regexp_replace(answer, '^{_WS}+|{_WS}+$', '', 'g') AS t, string_split_regex(regexp_replace(answer, '^{_WS}+|{_WS}+$', '', 'g'), '{_WS}+') AS w FROM p),
    c AS (SELECT CASE WHEN regexp_matches(lower(question), '{T.READING_PATTERN}') OR regexp_matches(lower(answer), '{T.READING_PATTERN}') THEN 'reading' WHEN length(answer) > 400 THEN 'long'
        WHEN t IN ({_quoted(T.BAD_ANSWERS)[1:-1]}) OR t LIKE '%,' OR {_STUMP} THEN 'truncated' ELSE 'kept' END AS reason FROM r)
    SELECT reason, count(*) AS n, round(count(*) / (SELECT count(*) FROM c), 6) AS share FROM c GROUP BY reason""")
def w2_pair_drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs go for which reason, and their shares."""
    pairs = C.turn_pairs(table(spark, sf_dir, "conversations"))
    reasons = pairs.select(F.coalesce(C.drop_reason(F.col("question"), F.col("answer"), 400), F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    whole = reasons.agg(F.sum("n").alias("all"))
    return reasons.crossJoin(F.broadcast(whole)).select("reason", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query("""WITH f AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS question, arg_min(text, turn) FILTER (role = 'assistant') AS answer FROM conversations GROUP BY conv_id)
    SELECT conv_id, question, answer, CASE WHEN question IS NULL OR answer IS NULL THEN NULL ELSE trim(question) END AS gate,
      CASE WHEN conv_id % 2 = 0 THEN 1 ELSE -1 END * (len(string_split('<image>' || chr(10) || question, ' ')) + len(string_split(answer, ' ')))::INT AS words FROM f""")
def w3_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First exchange of each conversation as a training row: its gate text and signed length."""
    rows = C.first_exchange(table(spark, sf_dir, "conversations")).withColumn("c", C.training_row(F.col("question"), F.col("answer")))
    both = F.col("question").isNotNull() & F.col("answer").isNotNull()
    return rows.select("conv_id", "question", "answer", F.when(both, C.gate_text(F.col("c"))).alias("gate"), F.when(both, C.signed_length(F.col("c"), F.col("conv_id") % 2 == 0)).alias("words"))


@query("""SELECT conv_id, count(*)::INT AS n_turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id""")
def w4_conversation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one text."""
    return C.document(table(spark, sf_dir, "conversations"))
