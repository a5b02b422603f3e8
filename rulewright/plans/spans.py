"""Queries that choose short answers within long ones; parts give questions, answers and what a model said."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.functions import text as T
from rulewright.operators import spans as S
from rulewright.plans.catalog import query
from rulewright.plans.texts import _quoted
from rulewright.sources.tables import table

_QUESTIONS = [
    "Is the {} red or blue?", "What color is the {}?", "How many {}s are on the table?", "Where is the {}?", "What is the {} made of?", "Is there any {} or glass?", "Which room is the {} in?", "Is it a small ring in the scene or the 2 red bolts?",
    "please provide a short description for this region: {}", "please provide the bounding box coordinate of the region this sentence describes: {}", "What is behind it?",
]
_ANSWERS = [
    "Yes, the {} is red and blue.", "The {} is on the left side of the two wooden tables.", "There are 007 of them in the living room", "It is behind the {} at the side", "the", "", "A {} on the side", "two on the left and a glass {}", "No, they are being used",
    "The small ring",
]
_SAID = ["red", "two", "{}", "", "the living room", "on the side of the road today", "7"]


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda texts, step: F.replace(F.element_at(F.array(*[F.lit(t) for t in texts]), (F.floor(k / step) % len(texts) + 1).cast("int")), F.lit("{}"), F.col("p_name"))
    return table(spark, sf_dir, "part").select(k.alias("global_index"), k.alias("question_id"), (k % 100).alias("image_id"), pick(_QUESTIONS, 1).alias("question"), pick(_ANSWERS, 3).alias("answer"), pick(_SAID, 7).alias("said"))


def _in(x: str, *lists: list[str]) -> str:
    return f"{x} IN ({_quoted([w for words in lists for w in words])[1:-1]})"


def _canon(x: str) -> str:
    numbers = " ".join(f"WHEN t = '{a}' THEN '{b}'" for a, b in T.NUMBER_WORDS.items())
    return f"[CASE WHEN regexp_full_match(t, '[0-9]+') THEN regexp_replace(t, '^0+([0-9])', '\\1') {numbers} ELSE t END for t in {x}]"


def _f1(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN {both} > 0 THEN 2.0 * {both} / (len(list_distinct({a})) + len(list_distinct({b}))) ELSE 0 END"


def _norm(x: str) -> str:
    return f"lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"


_STOP, _CLAUSE, _PLACE = S.STOPWORDS, S.CLAUSE_WORDS, S.LOCATION_WORDS + S.LOCATION_NOUNS
_YESNO_STARTS = " OR ".join(f"starts_with(q, '{w}')" for w in T.YESNO_OR_STARTS)
_TAILS = " ".join(
    f"WHEN len(s) > {len(t.split())} AND array_to_string(s[len(s) - {len(t.split()) - 1}:], ' ') = '{t}' AND len([t for t in s[:len(s) - {len(t.split())}] if NOT ({_in('t', _STOP, _CLAUSE)})]) > 0 THEN {len(t.split())}" for t in S.LOCATION_TAILS
)
_SQL = f"""r AS (SELECT p_partkey AS id, replace({_quoted(_QUESTIONS)}[p_partkey % {len(_QUESTIONS)} + 1], '{{}}', p_name) AS question, replace({_quoted(_ANSWERS)}[p_partkey // 3 % {len(_ANSWERS)} + 1], '{{}}', p_name) AS answer,
      replace({_quoted(_SAID)}[p_partkey // 7 % {len(_SAID)} + 1], '{{}}', p_name) AS said FROM part),
    w AS (SELECT *, {_norm("question")} AS q, regexp_extract_all({_norm("question")}, '[a-z0-9]+(?:''[a-z0-9]+)?') AS asked, regexp_extract_all({_norm("answer")}, '[a-z0-9]+(?:''[a-z0-9]+)?') AS a, regexp_extract_all({_norm("said")}, '[a-z0-9]+(?:''[a-z0-9]+)?') AS m FROM r),
    kinds AS (SELECT *, CASE WHEN starts_with(q, 'where ') OR contains(' ' || q || ' ', ' position ') OR contains(' ' || q || ' ', ' located ') THEN 'location' WHEN starts_with(q, 'can you ') OR starts_with(q, 'could you ') OR starts_with(q, 'would you ') THEN 'other'
        WHEN {_in("asked[1]", T.AUXILIARIES)} THEN CASE WHEN list_contains(string_split(q, ' '), 'or') AND NOT (list_contains(string_split(q, ' '), 'either') OR {_YESNO_STARTS} OR (regexp_matches(q, '^(is|are) there ') AND list_contains(string_split(q, ' '), 'any'))) THEN 'choice' ELSE 'yesno' END
        WHEN list_contains(string_split(q, ' '), 'or') THEN 'choice' WHEN starts_with(q, 'how many') OR list_contains(string_split(q, ' '), 'number') THEN 'count' WHEN list_contains(string_split(q, ' '), 'color') OR list_contains(string_split(q, ' '), 'colour') THEN 'color'
        WHEN list_contains(string_split(q, ' '), 'room') THEN 'room' WHEN list_contains(string_split(q, ' '), 'material') OR contains(' ' || q || ' ', ' made of ') THEN 'material' ELSE 'other' END AS kind FROM w),
    wins AS (SELECT id, unnest(list_concat([asked[i - n:i - 1] for n in range(1, least(4, i - 1) + 1)], [asked[i + 1:i + n] for n in range(1, least(4, len(asked) - i) + 1)])) AS o FROM (SELECT id, asked, unnest([i for i in range(1, len(asked) + 1) if asked[i] = 'or']) AS i FROM w)),
    cut AS (SELECT id, o[list_position([{_in("t", S.EDGE_WORDS)} for t in o], false):len(o) - list_position([{_in("t", S.EDGE_WORDS, S.CONTEXT_WORDS)} for t in list_reverse(o)], false) + 1] AS o FROM wins
            WHERE list_position([{_in("t", S.EDGE_WORDS)} for t in o], false) > 0 AND list_position([{_in("t", S.EDGE_WORDS, S.CONTEXT_WORDS)} for t in o], false) > 0),
    opts AS (SELECT id, list(DISTINCT {_canon("o")}) AS options FROM cut WHERE len(o) BETWEEN 1 AND 4 AND len([t for t in o if NOT ({_in("t", _STOP)})]) > 0 GROUP BY id),
    runs AS (SELECT id, unnest(flatten([[{{'s': a[i:i + n - 1], 'place': i * 10 + n}} for n in range(1, least(4, len(a) - i + 1) + 1)] for i in range(1, len(a) + 1)])) AS x FROM w),
    sp AS (SELECT id, x.s AS s, min(x.place) AS place FROM runs WHERE len([t for t in x.s if NOT ({_in("t", _STOP)})]) > 0
           AND NOT (len(x.s) >= 2 AND regexp_full_match(x.s[1], '[0-9]+') AND len([t for t in x.s[2:] if NOT ({_in("t", _STOP)})]) > 0 AND len([t for t in x.s[2:] if NOT ({_in("t", _STOP, _PLACE)})]) = 0) GROUP BY ALL),
    f AS (SELECT k.*, s, place, {_canon("s")} AS c, {_canon("m")} AS cm, coalesce(options, []) AS options, [t for t in s if NOT ({_in("t", _STOP, _CLAUSE)})] AS content, [t for t in s if NOT ({_in("t", _STOP, _CLAUSE)}) AND NOT list_contains(asked, t)] AS fresh,
        [t for t in {_canon("s")} if NOT ({_in("t", _STOP)})] AS own, CASE {_TAILS} ELSE 0 END AS tail FROM sp JOIN kinds k USING (id) LEFT JOIN opts USING (id)),
    g AS (SELECT *, len(m) BETWEEN 1 AND 4 AND (s = m OR c = cm) AS same, len(content) > 0 AND len([t for t in content if NOT list_contains(asked, t)]) = 0 AS all_asked, CASE WHEN kind <> 'choice' THEN 0 WHEN list_contains(options, c) THEN 50.0 + 5.0 * len(c)
        ELSE coalesce(list_max([greatest(CASE WHEN len(c) >= 2 AND len(o) >= len(c) AND (o[:len(c)] = c OR o[len(o) - len(c) + 1:] = c) THEN 24.0 ELSE 0 END,
          CASE WHEN len(list_intersect(own, [t for t in o if NOT ({_in("t", _STOP)})])) >= 2 THEN 12.0 + 4.0 * len(list_intersect(own, [t for t in o if NOT ({_in("t", _STOP)})])) ELSE 0 END) for o in options]), 0) END AS fit FROM f),
    h AS (SELECT id, kind, same, s, place, CASE WHEN same THEN 100.0 ELSE 0 END + CASE WHEN len(m) > 0 THEN 30.0 * ({_f1("c", "cm")}) ELSE 0 END
        + CASE WHEN kind = 'yesno' AND array_to_string(s, ' ') IN ('yes', 'no') THEN 45 WHEN kind = 'count' AND len([t for t in c if NOT regexp_full_match(t, '[0-9]+')]) = 0 THEN 35
          WHEN kind = 'color' AND len([t for t in s if NOT ({_in("t", S.COLOR_WORDS, ["and"])})]) = 0 AND len([t for t in s if {_in("t", S.COLOR_WORDS)}]) > 0 THEN 30 WHEN kind = 'room' AND {_in("array_to_string(s, ' ')", S.ROOM_PHRASES)} THEN 25
          WHEN kind = 'material' AND len([t for t in s if {_in("t", S.MATERIAL_WORDS)}]) > 0 THEN 20 WHEN kind = 'location' AND {_in("s[1]", S.LOCATION_WORDS)} THEN 30 ELSE 0 END
        + fit - CASE WHEN len(s) > 4 THEN 5 ELSE 0 END - 0.35 * len(s) - CASE WHEN {_in("s[-1]", _STOP)} THEN 18 ELSE 0 END - CASE WHEN {_in("s[1]", S.WEAK_STARTS)} THEN 4 ELSE 0 END - CASE WHEN len([t for t in s if {_in("t", _CLAUSE)}]) > 0 THEN 12 ELSE 0 END
        + 4.0 * len(fresh) + CASE WHEN len(fresh) > 0 AND list_contains(asked, s[-1]) AND NOT ({_in("s[-1]", _STOP)}) THEN 8 ELSE 0 END - CASE WHEN len(fresh) = 0 THEN 6 ELSE 0 END - CASE WHEN len(content) >= 2 AND all_asked THEN 16 ELSE 0 END
        - CASE WHEN kind = 'choice' AND len(options) > 0 AND fit <= 0 THEN CASE WHEN all_asked THEN 18 ELSE 9 END ELSE 0 END
        - CASE WHEN kind <> 'location' AND len(content) > 0 AND len([t for t in content if NOT ({_in("t", _PLACE)})]) = 0 THEN 28 ELSE 0 END - CASE WHEN kind <> 'location' AND tail > 0 THEN 12 + 4 * tail ELSE 0 END AS score FROM g),
    top AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(score, 6) DESC, place) = 1)"""


@query(f"WITH {_SQL} SELECT id AS global_index, list_reduce(list_concat([''], [array_to_string(o, ' ') for o in options]), lambda x, y: CASE WHEN x = '' THEN y ELSE x || '|' || y END) AS options FROM (SELECT id, list_sort(options) AS options FROM opts)")
def s1_choice_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The options that questions with "or" give."""
    rows = _rows(spark, sf_dir).select("global_index", F.array_sort(F.array_distinct(F.transform(S.choice_options(S.tokens_of(F.col("question"))), S.canonical))).alias("o"))
    return rows.filter(F.size("o") > 0).select("global_index", F.array_join(F.transform("o", lambda o: F.array_join(o, " ")), "|").alias("options"))


@query(f"WITH {_SQL} SELECT id AS global_index, array_to_string(s, ' ') AS span, round(score, 6) AS score FROM h")
def s2_scored_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spans of answers with their scores."""
    return S.scored_spans(_rows(spark, sf_dir), "global_index", 4).select("global_index", "span", F.round("score", 6).alias("score"))


@query(f"""WITH {_SQL}, fam AS (SELECT *, CASE WHEN starts_with(q, '{T.BOX_START}') THEN 'bbox_coord' WHEN starts_with(q, '{T.REGION_START}') THEN 'region_desc' ELSE 'other' END AS family FROM w)
    SELECT id AS global_index, id AS question_id, id % 100 AS image_id, question, answer, CASE WHEN family = 'other' THEN {_norm("said")} ELSE '' END AS model_output, CASE WHEN family <> 'other' THEN '' ELSE coalesce(array_to_string(s, ' '), {_norm("answer")}) END AS short_answer,
      CASE WHEN family <> 'other' THEN 'skipped_' || family WHEN s IS NULL THEN 'fallback_full_answer' WHEN same THEN 'aligned_exact' WHEN kind <> 'other' THEN 'aligned_' || kind ELSE 'aligned_overlap' END AS selection_method,
      round(CASE WHEN family <> 'other' THEN -1 ELSE coalesce(score, 0) END, 6) AS selection_score, family AS question_family, 0 AS shard_id, 1 AS num_shards FROM fam LEFT JOIN top USING (id)""")
def s3_compressed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question with its short answer, how it was chosen and its score."""
    return S.compressed_answers(_rows(spark, sf_dir)).withColumn("selection_score", F.round("selection_score", 6))


@query(f"""WITH {_SQL} SELECT id AS global_index FROM w JOIN top USING (id) WHERE score >= 15 AND NOT starts_with(q, 'please provide')""")
def s4_usable_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compressed answers that score enough."""
    return S.usable_answers(S.compressed_answers(_rows(spark, sf_dir)), 15.0).select("global_index")
