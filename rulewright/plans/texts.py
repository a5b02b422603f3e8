"""Text functions over conversations and over questions made of the parts' names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.functions import text as T
from rulewright.plans.catalog import query
from rulewright.sources.tables import table

_QUESTIONS = [
    "Where is the {}?", "Is the {} red or blue ?", "How many people are near the {}<image>?", "What  color are the {}s?", "Are there any {} or glasses",
    "Can you see any dishes?", "What is the boxes's material made of", "what is written on the {}?", "Which room has wolves, knives and berries?",
    "please provide a short description for this region: {}",
]
_ANSWERS = ["yes", "No, it isn't.", "007", "the {}", "", "There is", "{},", "It is a", "Not sure.\nAgain, no", "12 one-way [signs]", "A. {}", "The answer is B.", "8,7", "six the cats, and two dogs."]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, image_id, question, answer, answer_type) of every part."""
    pick = lambda texts, step: F.replace(F.element_at(F.array(*[F.lit(t) for t in texts]), (F.floor(F.col("p_partkey") / step) % len(texts) + 1).cast("int")), F.lit("{}"), F.col("p_name"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("question_id"), (F.col("p_partkey") % 100).alias("image_id"), pick(_QUESTIONS, 1).alias("question"), pick(_ANSWERS, 3).alias("answer"),
        F.when(F.col("p_partkey") % 4 == 0, F.lit(" Other ")).when(F.col("p_partkey") % 4 == 1, F.lit("unknown")).alias("answer_type"),
    )


def _quoted(texts: list[str] | dict) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in texts) + "]"


def _case(pairs: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs.items()) + f" ELSE {key} END"


QUESTIONS_SQL = f"""q AS (SELECT p_partkey AS question_id, p_partkey % 100 AS image_id,
    replace({_quoted(_QUESTIONS)}[(p_partkey % {len(_QUESTIONS)}) + 1], '{{}}', p_name) AS question,
    replace({_quoted(_ANSWERS)}[(p_partkey // 3) % {len(_ANSWERS)} + 1], '{{}}', p_name) AS answer,
    CASE p_partkey % 4 WHEN 0 THEN ' Other ' WHEN 1 THEN 'unknown' END AS answer_type FROM part)"""
_WS = r"[ \t\n\x0b\f\r]"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '<image>', ' ', 'g'), '{_WS}+', ' ', 'g'))"


def _singular(t: str, untouched: list[str]) -> str:
    return f"""CASE WHEN {t} IN ({_quoted(list(T.IRREGULAR))[1:-1]}) THEN {_case(T.IRREGULAR, t)}
        WHEN {t} IN ({_quoted(untouched)[1:-1]}) OR length({t}) <= 3 THEN {t}
        WHEN {t} LIKE '%ies' AND length({t}) > 4 THEN {t}[:-4] || 'y' WHEN {t} LIKE '%ives' AND length({t}) > 4 THEN {t}[:-4] || 'fe'
        WHEN {t} LIKE '%ves' AND length({t}) > 4 THEN {t}[:-4] || 'f' WHEN regexp_matches({t}, '(sses|ches|shes|xes|zes)$') AND length({t}) > 4 THEN {t}[:-3]
        WHEN {t} LIKE '%es' AND length({t}) > 4 THEN {t}[:-2] WHEN {t} LIKE '%s' AND NOT regexp_matches({t}, '(ss|us|is|es)$') THEN {t}[:-2] ELSE {t} END"""


_TOKENS = f"list_transform(list_filter(regexp_extract_all(lower({_norm('text')}), '[a-z0-9]+'), lambda t: t <> 's'), lambda t: {_singular('t', T.UNTOUCHED_TOKENS)})"


@query(f"""WITH {QUESTIONS_SQL}, a AS (SELECT 'q' || question_id AS id, question AS text FROM q UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations)
    SELECT id, array_to_string({_TOKENS}, ' ') AS tokens, lower({_norm("text")}) AS plain FROM a""")
def text_question_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised texts and their singular tokens, of questions and conversation turns."""
    own = questions(spark, sf_dir).select(F.concat(F.lit("q"), "question_id").alias("id"), F.col("question").alias("text"))
    turns = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), "text")
    return own.unionByName(turns).select("id", F.array_join(T.question_tokens(F.col("text")), " ").alias("tokens"), T.normalized_answer(F.col("text")).alias("plain"))


_CUE_NAMES = ["The TV-monitor", "{}", "cell_phones", "a {}s", "Air plane", "glasses", "people / men", "An aeroplane!", "-- ", "mobile phones"]


@query(f"""WITH n AS (SELECT p_partkey, replace({_quoted(_CUE_NAMES)}[p_partkey % {len(_CUE_NAMES)} + 1], '{{}}', p_name) AS name FROM part),
    s AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '[_\\-/]+', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS s FROM n),
    b AS (SELECT *, {_case(T.CUE_ALIASES, "regexp_replace(s, '^(a|an|the) ', '')")} AS b FROM s),
    w AS (SELECT *, string_split(b, ' ')[-1] AS w FROM b),
    c AS (SELECT p_partkey, name, s, b[:length(b) - length(w)] || {_singular("w", T.UNTOUCHED_OBJECTS)} AS c FROM w)
    SELECT p_partkey, name, CASE WHEN s = '' THEN '' ELSE {_case(T.CUE_ALIASES, "c")} END AS cue FROM c""")
def text_visual_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised object names."""
    names = F.element_at(F.array(*[F.lit(t) for t in _CUE_NAMES]), (F.col("p_partkey") % len(_CUE_NAMES) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.replace(names, F.lit("{}"), F.col("p_name")).alias("name"))
    return rows.withColumn("cue", T.visual_cue(F.col("name")))


_TYPE = f"""CASE WHEN starts_with(x, 'where ') OR contains(p, ' position ') OR contains(p, ' located ') THEN 'location'
    WHEN regexp_matches(x, '^(can|could|would) you ') THEN 'other'
    WHEN regexp_extract(x, '[a-z0-9]+(''[a-z0-9]+)?') IN ({_quoted(T.AUXILIARIES)[1:-1]}) THEN
        CASE WHEN contains(p, ' or ') AND NOT (contains(p, ' either ') OR regexp_matches(x, '^(are there any|can you see any|do you see any|does the image show any|is there any) ')
            OR (regexp_matches(x, '^(is there|are there|do you see|can you see) ') AND contains(p, ' any '))) THEN 'choice' ELSE 'yesno' END
    WHEN contains(p, ' or ') THEN 'choice' WHEN starts_with(x, 'how many') OR contains(p, ' number ') THEN 'count'
    WHEN contains(p, ' color ') OR contains(p, ' colour ') THEN 'color' WHEN contains(p, ' room ') THEN 'room'
    WHEN contains(p, ' material ') OR contains(p, ' made of ') THEN 'material' ELSE 'other' END"""
_ANSWER_TYPE = f"""CASE WHEN trim(coalesce(answer_type, '')) NOT IN ('', 'unknown') THEN lower(trim(answer_type))
    WHEN lower(trim(answer)) IN ('yes', 'no', 'true', 'false') THEN 'yes/no' WHEN regexp_matches(trim(answer), '^[0-9]+$') THEN 'number' WHEN trim(answer) <> '' THEN 'other' ELSE 'unknown' END"""


@query(f"""WITH {QUESTIONS_SQL}, n AS (SELECT *, lower({_norm("question")}) AS x FROM q), m AS (SELECT *, ' ' || x || ' ' AS p FROM n)
    SELECT question_id, {_TYPE} AS question_type, CASE WHEN starts_with(x, '{T.REGION_START}') THEN 'region_desc' ELSE 'other' END AS family, {_ANSWER_TYPE} AS answer_type,
           format('COCO_train2014_{{:012d}}.jpg', image_id) AS file, x ~ 'x' AND FALSE AS has_box FROM m""")
def text_question_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type and family of each question, type of its answer, and its image's file name."""
    plain = T.normalized_answer(F.col("question"))
    return questions(spark, sf_dir).select(
        "question_id", T.question_type(plain).alias("question_type"), T.question_family(plain).alias("family"), T.answer_type(F.col("answer_type"), F.col("answer")).alias("answer_type"),
        T.image_file(F.col("image_id")).alias("file"), (T.question_family(plain) == "bbox_coord").alias("has_box"),
    )


_TRIM = f"regexp_replace(answer, '^{_WS}+|{_WS}+$', '', 'g')"
_BARE = "regexp_replace(lower({}), '^[,.;:!?\"'']+|[,.;:!?\"'']+$', '', 'g')"
_STUMP = f"""(len(w) BETWEEN 2 AND 8 AND NOT regexp_matches(t, '[.!?]$') AND ({_BARE.format("w[-1]")} IN ('a', 'an', 'the')
    OR ({_BARE.format("w[1]")} IN ({_quoted(T.LEADING_WORDS)[1:-1]}) AND {_BARE.format("w[-1]")} IN ({_quoted(T.BAD_LAST_WORDS)[1:-1]}))))"""
_FIRST = "string_split({}, '.')[1]"
_ANSWER_ROWS = f"WITH {QUESTIONS_SQL}, r AS (SELECT *, {_TRIM} AS t, string_split_regex({_TRIM}, '{_WS}+') AS w FROM q)"


@query(f"""{_ANSWER_ROWS} SELECT question_id, t IN ({_quoted(T.BAD_ANSWERS)[1:-1]}) OR t LIKE '%,' OR {_STUMP} AS truncated,
    t IN ({_quoted(T.BAD_ANSWERS + T.MORE_BAD_ANSWERS)[1:-1]}) OR t LIKE '%,' OR {_STUMP} AS truncated_more,
    t <> '' AND (regexp_matches(lower(t), 'the answer is|in the image|are you|again,|an answer|the last one') OR contains(t, chr(10)) OR regexp_matches(regexp_replace(t, '{_WS}', '', 'g'), '^[0-9]{{5,}}$') OR regexp_matches(t, '[{{}}\\[\\]|\\\\]')) AS bad,
    lower(t) IN ('', 'no image', 'unknown', 'image not available', 'unable to determine') OR (question_id % 2 = 0 AND len(w) <= 2) AS retry FROM r""")
def text_answer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truncated, bad and retry-worthy answers."""
    a = F.col("answer")
    finish = F.when(F.col("question_id") % 2 == 0, "LENGTH").otherwise("stop")
    return questions(spark, sf_dir).select("question_id", T.is_truncated(a).alias("truncated"), T.is_truncated(a, True).alias("truncated_more"), T.looks_bad(a).alias("bad"), T.needs_retry(a, finish).alias("retry"))


@query(f"""{_ANSWER_ROWS}, l AS (SELECT *, lower(answer) AS low, CASE question_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'maybe' END AS label FROM r)
    SELECT question_id, CASE WHEN list_has_any(string_split_regex(lower(replace({_FIRST.format("t")}, ',', '')), '{_WS}+'), ['no', 'not']) THEN 'no' ELSE 'yes' END AS by_words,
    CASE WHEN list_has_any(string_split(replace({_FIRST.format("answer")}, ',', ''), ' '), ['No', 'not', 'no']) THEN 'no' ELSE 'yes' END AS by_exact_words,
    CASE label WHEN 'yes' THEN CASE WHEN contains(low, 'yes') THEN 'TP' ELSE 'FN' END WHEN 'no' THEN CASE WHEN contains(low, 'no') THEN 'TN' ELSE 'FP' END END AS contained,
    CASE WHEN contains(low, 'yes') THEN 'yes' WHEN contains(low, 'no') THEN 'no' WHEN starts_with(lower(t), 'y') THEN 'yes' WHEN starts_with(lower(t), 'n') THEN 'no' ELSE 'invalid' END AS lenient,
    lower(t) IN ('yes', 'no') AS plain FROM l""")
def text_yes_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five readings of an answer as yes or no."""
    a = F.col("answer")
    label = F.when(F.col("question_id") % 3 == 0, "yes").when(F.col("question_id") % 3 == 1, "no").otherwise("maybe")
    return questions(spark, sf_dir).select(
        "question_id", T.yes_no_words(a).alias("by_words"), T.yes_no_exact_words(a).alias("by_exact_words"), T.yes_no_contained(label, a).alias("contained"), T.yes_no_lenient(a).alias("lenient"), T.is_yes_no(a).alias("plain")
    )


_NUM = f"CASE WHEN regexp_matches(t, '^[0-9]+$') THEN CASE WHEN ltrim(t, '0') = '' THEN '0' ELSE ltrim(t, '0') END ELSE {_case(T.NUMBER_WORDS, 't')} END"
_TOK = f"list_transform(regexp_extract_all(lower({_norm('{}')}), '[a-z0-9]+(?:''[a-z0-9]+)?'), lambda t: {_NUM})"


@query(f"""WITH {QUESTIONS_SQL}, t AS (SELECT *, list_distinct({_TOK.replace("{}", "answer")}) AS a, list_distinct({_TOK.replace("{}", "question")}) AS b, array_to_string({_TOK.replace("{}", "answer")}, ' ') AS tokens FROM q),
    i AS (SELECT *, len(list_intersect(a, b)) AS s FROM t)
    SELECT question_id, tokens, CASE WHEN s > 0 THEN round(2.0 * s / (len(a) + len(b)), 9) ELSE 0 END AS f1,
      CASE WHEN answer IN ('A', 'B', 'C', 'D') THEN answer WHEN regexp_matches(answer, '^[A-D]\\. ') THEN answer[1] WHEN len(regexp_extract_all(answer, 'The answer is ([A-Z]).')) = 1 THEN regexp_extract(answer, 'The answer is ([A-Z]).', 1) ELSE 'FAILED' END AS letter,
      CASE WHEN len(p) = 2 AND try_cast(p[1] AS DOUBLE) IS NOT NULL AND try_cast(p[2] AS DOUBLE) IS NOT NULL THEN p[1]::DOUBLE - p[2]::DOUBLE ELSE 0 END AS difference
    FROM (SELECT *, string_split(replace(string_split(answer, chr(10))[1], ',', ' '), ' ') AS p FROM i)""")
def text_answer_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical tokens, their overlap with the question's, choice letters and score pairs."""
    a, tokens = F.col("answer"), T.answer_tokens(F.col("answer"))
    pair = T.score_pair(a)
    return questions(spark, sf_dir).select(
        "question_id", F.array_join(tokens, " ").alias("tokens"), F.round(T.overlap_f1(tokens, T.answer_tokens(F.col("question"))), 9).alias("f1"), T.choice_letter(a, ["A", "B", "C", "D"]).alias("letter"), (pair[0] - pair[1]).alias("difference")
    )


@query("""SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS leaf, lower(url) LIKE '%.html' OR lower(url) LIKE '%.htm' AS html_name,
    CASE WHEN regexp_matches(lower(html), '(^|[^a-z0-9_])(image|picture|photo|photograph|scene|visible|shown)([^a-z0-9_]|$)') OR contains(html, '<image>') THEN 1 ELSE 0 END AS image,
    regexp_matches(lower(html), '(^|[^a-z0-9_])(ocr|read (the )?text|text in (the )?(image|picture|photo)|what does .* say|what is written|written on|transcribe|transcription|words? on|letters? on|license plate)([^a-z0-9_]|$)') AS reading FROM pages""")
def text_page_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that speak of images or of reading text, and the last part of their addresses."""
    return table(spark, sf_dir, "pages").select(
        "page_id", T.after_last(F.col("url"), "/").alias("leaf"), F.lower("url").rlike(r"\.html?$").alias("html_name"), T.mentions_image(F.col("html")).cast("int").alias("image"), T.is_reading_text(F.col("html")).alias("reading")
    )


@query("""SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k, json_type(props::JSON) = 'OBJECT' AS is_object,
    coalesce(nullif(trim(event_type), ''), 'none') AS kind, event_type IS NULL OR lower(event_type) IN ('nan', 'none') AS nullish FROM events""")
def text_event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of JSON texts that must be objects."""
    parsed = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False)).alias("is_object"),
        F.coalesce(T.first_filled(F.col("event_type")), F.lit("none")).alias("kind"), T.is_nullish(F.col("event_type")).alias("nullish"),
    )
