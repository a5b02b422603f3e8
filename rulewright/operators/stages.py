"""From matched rules to training rows: merged matches, eligible candidates, generated rows of a model's responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulewright.functions import text as T

#: The rule id of a question that no rule matched.
UNMATCHED = "0"
_NO_WORDS = "array<string>"


def _words(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast(_NO_WORDS))


def merged_matches(matches: DataFrame, rules: DataFrame, questions: DataFrame, annotations: DataFrame, unmatched: bool = False) -> DataFrame:
    """(question_id, image_id, text_keywords, visual_cues, answer, answer_type) of the matches with their rules.

    Matches without a known rule are left out, or with ``unmatched`` stay with empty fields. An
    image id that a match lacks comes from its question; the answer's type is the question's, else
    the annotation's, else unknown. rule_id and question_id are keys of their tables.
    """
    own = questions.select("question_id", F.col("image_id").alias("__image"), F.col("answer_type").alias("__asked"))
    noted = annotations.select("question_id", F.col("answer_type").alias("__noted"))
    known = rules.select("rule_id", "text_keywords", "visual_cues", "answer", F.lit(True).alias("__rule"))
    rows = matches.select("question_id", "image_id", F.coalesce("rule_id", F.lit(UNMATCHED)).alias("rule_id")).join(known, "rule_id", "left")
    if not unmatched:
        rows = rows.filter((F.col("rule_id") != UNMATCHED) & F.col("__rule"))
    rows = rows.join(own, "question_id", "left").join(noted, "question_id", "left")
    kind = F.coalesce(F.lower(T.first_filled(F.col("__asked"), F.col("__noted"))), F.lit("unknown"))
    return rows.select(
        "question_id", F.coalesce("image_id", "__image").alias("image_id"), _words("text_keywords").alias("text_keywords"), _words("visual_cues").alias("visual_cues"),
        F.coalesce("answer", F.lit("")).alias("answer"), kind.alias("answer_type"),
    )


def matched_questions(questions: DataFrame, matches: DataFrame, rules: DataFrame) -> DataFrame:
    """Questions with their matched rule as a struct (null where none matched) and matched, whether there is one."""
    own = rules.select("rule_id", F.struct("rule_id", "text_keywords", "visual_cues", "answer").alias("rule"))
    told = matches.filter(F.col("rule_id") != UNMATCHED).join(own, "rule_id").select("question_id", "rule")
    return questions.join(told, "question_id", "left").withColumn("matched", F.col("rule").isNotNull())


def filled_words(words: Column) -> Column:
    """The words without blanks at their ends, empty and null ones left out."""
    return F.filter(F.transform(_words(words), T.trimmed), lambda w: w.isNotNull() & (w != ""))


def candidate_rows(merged: DataFrame, questions: DataFrame) -> DataFrame:
    """The merged rows with trimmed words, their question and image file, and reason, why a row is skipped.

    A row needs a keyword, a cue and a known question; the reason is null where it has all of them.
    """
    rows = merged.withColumns({"text_keywords": filled_words(F.col("text_keywords")), "visual_cues": filled_words(F.col("visual_cues"))})
    rows = rows.join(questions.select("question_id", T.trimmed(F.col("question")).alias("question"), F.lit(True).alias("__known")), "question_id", "left")
    no_words, no_cues = F.size("text_keywords") == 0, F.size("visual_cues") == 0
    reason = (
        F.when(no_words & no_cues, "no keywords and cues").when(no_words, "no keywords").when(no_cues, "no cues").when(F.col("__known").isNull(), "no question")
    )
    return rows.select(
        "question_id", "image_id", "question", T.image_file(F.col("image_id")).alias("image"), "text_keywords", "visual_cues", T.trimmed(F.col("answer")).alias("answer"), "answer_type", reason.alias("reason")
    )


def stage_inputs(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The eligible candidates, and for each its question alone: question_id, image_id, image, text."""
    kept = candidates.filter("reason is null").drop("reason")
    return kept, kept.select("question_id", "image_id", "image", F.col("question").alias("text"))


def skip_counts(candidates: DataFrame) -> DataFrame:
    """total, selected, and how many rows lack both kinds of words or one, a keyword, a cue, a question; one row."""
    n = lambda *reasons: F.count(F.when(F.col("reason").isin(*reasons), 1))
    none, words, cues = "no keywords and cues", "no keywords", "no cues"
    return candidates.agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("reason").isNull(), 1)).alias("selected"), n(none, words, cues).alias("ineligible"),
        n(none, words).alias("without_keywords"), n(none, cues).alias("without_cues"), n("no question").alias("without_question"),
    )


def model_object(text: Column) -> Column:
    """A JSON object as a variant; null for a text that is no JSON or another kind of value."""
    parsed = F.try_parse_json(T.trimmed(text))
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)


def lenient_object(text: Column) -> Column:
    """As ``model_object``, of a text that may stand in a code fence or between other words.

    Without a fence's marks the whole text is tried first, then what the outermost braces hold.
    """
    plain = T.trimmed(text)
    bare = F.when(plain.startswith("```"), F.regexp_replace(F.regexp_replace(plain, r"^```(json)?[ \t\n\x0b\f\r]*", ""), r"[ \t\n\x0b\f\r]*```$", "")).otherwise(plain)
    return F.coalesce(model_object(bare), model_object(F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))))


def text_field(value: Column, name: str) -> Column:
    """A field of a variant as a text without blanks at its ends; empty where there is none."""
    return F.coalesce(T.trimmed(F.try_variant_get(value, f"$.{name}", "string")), F.lit(""))


def response_text(payload: Column) -> Column:
    """The texts of all messages of a response's output, joined by newlines."""
    schema = "output array<struct<type: string, content: array<struct<type: string, text: string>>>>"
    messages = F.filter(F.from_json(payload, schema)["output"], lambda x: x["type"] == "message")
    parts = F.flatten(F.transform(messages, lambda x: F.coalesce(x["content"], F.array().cast("array<struct<type:string,text:string>>"))))
    said = F.filter(parts, lambda x: x["type"].isin("output_text", "text") & F.coalesce(x["text"] != "", F.lit(False)))
    return F.coalesce(F.array_join(F.transform(said, lambda x: x["text"]), "\n"), F.lit(""))


def chat_text(payload: Column) -> Column:
    """The text of a response payload of either shape, without blanks at its ends; null where it has neither.

    A list of choices that isn't empty counts first, by its first message: its content is a text, or parts of which those of the type text are
    joined by newlines. Else the parts of all outputs, of the types output_text and text, are joined.
    """
    v, parts = F.try_parse_json(payload), "array<struct<type: string, text: string>>"
    content = F.from_json(payload, f"choices array<struct<message: struct<content: {parts}>>>")["choices"]
    said = lambda found, *kinds: T.trimmed(F.array_join(F.filter(F.transform(F.filter(found, lambda x: x["type"].isin(*kinds)), lambda x: F.coalesce(x["text"], F.lit(""))), lambda t: t != ""), "\n"))
    first = F.try_variant_get(v, "$.choices[0]", "variant")
    kind = F.schema_of_variant(F.try_variant_get(v, "$.choices[0].message.content", "variant"))
    outputs = F.from_json(payload, f"output array<struct<content: {parts}>>")["output"]
    every = F.flatten(F.transform(outputs, lambda x: F.coalesce(x["content"], F.array().cast("array<struct<type:string,text:string>>"))))
    of_choice = F.when(kind == "STRING", T.trimmed(F.try_variant_get(v, "$.choices[0].message.content", "string"))).when(kind.startswith("ARRAY"), said(F.get(content, F.lit(0))["message"]["content"], "text"))
    missing = F.when(first.isNotNull() & kind.isNull(), "")
    return F.coalesce(of_choice, missing, F.when(outputs.isNotNull(), said(every, "output_text", "text")))


def judged_responses(responses: DataFrame, sources: DataFrame, need_status: bool = True, need_answer: bool = True) -> DataFrame:
    """All responses with the generated texts, their source row and reason, why one is skipped (null if it stays).

    ``responses`` has ord, custom_id, status_code, model, output_text and response_id. The source is found
    by what stands behind the last dash of custom_id. Reasons are checked in a fixed order, and
    of the valid responses to a source the first in ord stays; the others are ``repeated``.
    """
    key = T.trimmed(T.after_last(F.coalesce("custom_id", F.lit("")), "-"))
    object_ = model_object(F.col("output_text"))
    rows = responses.withColumn("source_key", key).withColumn("__said", object_)
    rows = rows.withColumns({"generated_question": text_field(F.col("__said"), "question"), "generated_answer": text_field(F.col("__said"), "answer")})
    own = sources.select(F.col("question_id").cast("string").alias("source_key"), F.struct(*[c for c in sources.columns]).alias("source"))
    rows = rows.join(own, "source_key", "left")
    bad_status = ~F.col("status_code").eqNullSafe(F.lit(200)) if need_status else F.lit(False)
    reason = (
        F.when(bad_status, "status").when(F.col("source_key") == "", "custom_id").when(F.col("source").isNull(), "source").when(F.col("__said").isNull(), "json")
        .when(F.col("generated_question") == "", "question").when((F.col("generated_answer") == "") & F.lit(need_answer), "answer")
    )
    rows = rows.withColumn("reason", reason).drop("__said")
    place = F.row_number().over(Window.partitionBy("source_key", F.col("reason").isNull()).orderBy("ord"))
    return rows.withColumn("__place", place).withColumn("reason", F.when(F.col("reason").isNull() & (F.col("__place") > 1), "repeated").otherwise(F.col("reason"))).drop("__place")


def generated_rows(judged: DataFrame) -> DataFrame:
    """The training rows of the responses that stay, with what they were made from."""
    s = lambda c: F.col(f"source.{c}")
    return judged.filter("reason is null").select(
        s("question_id").cast("long").alias("question_id"), F.col("generated_question").alias("question"), s("image_id").cast("long").alias("image_id"), F.col("generated_answer").alias("answer"),
        s("answer_type").alias("answer_type"), s("question").alias("original_question"), s("answer").alias("original_answer"), "generated_question", "generated_answer",
        s("text_keywords").alias("text_keywords"), s("visual_cues").alias("visual_cues"), s("image").alias("source_image"), F.col("model").alias("source_model"),
        F.col("custom_id").alias("source_custom_id"), F.col("response_id").alias("source_response_id"),
    )


def reason_counts(rows: DataFrame, kept: str = "kept") -> DataFrame:
    """(reason, n): how many rows each reason skips, and how many stay."""
    return rows.groupBy(F.coalesce("reason", F.lit(kept)).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def filled_prompt(template: str, **fields: Column) -> Column:
    """A template with each {name} replaced by its field's text."""
    out = F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def keyword_prompt(template: str, keywords: Column, answer: Column, answer_type: Column) -> Column:
    """The template's {keywords}, {original_answer} and {answer_type}, with words in brackets where they are empty."""
    joined = F.array_join(_words(keywords), ", ")
    filled = lambda c, empty: F.coalesce(F.nullif(c, F.lit("")), F.lit(empty))
    return filled_prompt(template, keywords=filled(joined, "(no keywords)"), original_answer=filled(answer, "(empty)"), answer_type=filled(answer_type, "(unknown)"))


# Media types by a file name's ending.
MEDIA_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "jpe": "image/jpeg", "png": "image/png", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp", "tif": "image/tiff", "tiff": "image/tiff"}


def data_url(path: Column, content: Column) -> Column:
    """A file's bytes as a data URL; endings that aren't known count as PNG."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])[ending], F.lit("image/png"))
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64(content))


def positional(left: DataFrame, right: DataFrame, order: str, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of two tables with the same place, and the places at which they don't fit: (order, problem).

    A place that only one table has, and with ``key`` one at which the keys differ, is a problem.
    """
    other = right.select(*[F.col(c).alias(c if c == order else f"right_{c}") for c in right.columns])
    both = left.withColumn("__l", F.lit(1)).join(other.withColumn("__r", F.lit(1)), order, "full")
    problem = F.when(F.col("__l").isNull() | F.col("__r").isNull(), "only one side")
    if key is not None:
        problem = F.coalesce(problem, F.when(~F.col(key).eqNullSafe(F.col(f"right_{key}")), "other key"))
    told = both.withColumn("problem", problem)
    return told.filter("problem is null").drop("problem", "__l", "__r"), told.filter("problem is not null").select(order, "problem")


def keyed(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of two tables with the same key, and the keys that are missing or repeated on a side: (key, problem)."""
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("l")).join(right.groupBy(key).agg(F.count(F.lit(1)).alias("r")), key, "full")
    problem = F.when(F.col("l").isNull(), "missing left").when(F.col("r").isNull(), "missing right").when((F.col("l") > 1) | (F.col("r") > 1), "repeated")
    told = counts.select(key, problem.alias("problem")).filter("problem is not null")
    return left.join(right, key), told


def three_way(ids: DataFrame, originals: DataFrame, others: DataFrame) -> DataFrame:
    """Chosen ids with their original and counter-example: question_id, status, image_id, image, answer_type, original, anti_shortcut.

    status is ``missing original``, ``missing other``, ``image differs``, ``type differs`` (which stays, with
    the counter-example's type) or ``kept``; the last columns are null where a row does not stay.
    """
    side = lambda rows, n: rows.select("question_id", F.col("image_id").alias(f"i{n}"), F.col("answer_type").alias(f"t{n}"), F.struct("question", "answer").alias(f"x{n}"))
    rows = ids.select("question_id").distinct().join(side(originals, 1), "question_id", "left").join(side(others, 2), "question_id", "left")
    status = (
        F.when(F.col("x1").isNull(), "missing original").when(F.col("x2").isNull(), "missing other").when(~F.col("i1").eqNullSafe(F.col("i2")), "image differs")
        .when(~F.col("t1").eqNullSafe(F.col("t2")), "type differs").otherwise("kept")
    )
    stays = F.col("status").isin("kept", "type differs")
    kind = F.coalesce(F.nullif("t2", F.lit("")), F.nullif("t1", F.lit("")), F.lit("unknown"))
    return rows.withColumn("status", status).select(
        "question_id", "status", F.when(stays, F.col("i1")).alias("image_id"), F.when(stays, T.image_file(F.col("i1"))).alias("image"), F.when(stays, kind).alias("answer_type"),
        F.when(stays, F.col("x1")).alias("original"), F.when(stays, F.col("x2")).alias("anti_shortcut"),
    )


def cue_sources(matches: DataFrame, rules: DataFrame, listings: list[DataFrame]) -> DataFrame:
    """(question_id, image_id, visual_cues, path): matches whose rule has cues and whose image is in a listing, the first that has it.

    Each listing has (image_id, path).
    """
    cues = rules.select("rule_id", filled_words(F.col("visual_cues")).alias("visual_cues")).filter(F.size("visual_cues") > 0)
    rows = matches.select("question_id", "image_id", "rule_id").join(cues, "rule_id").drop("rule_id")
    found = [x.groupBy("image_id").agg(F.min("path").alias(f"__p{i}")) for i, x in enumerate(listings)]
    for x in found:
        rows = rows.join(x, "image_id", "left")
    return rows.withColumn("path", F.coalesce(*[F.col(f"__p{i}") for i in range(len(found))])).filter("path is not null").select("question_id", "image_id", "visual_cues", "path")


def ensembled(problems: DataFrame, own: DataFrame, other: DataFrame, letters: list[str]) -> DataFrame:
    """(problem_id, correct, upper, failed) of the problems that both predictors answered.

    The other's choice counts, or, where none can be read from its text, the own one; ``upper`` is
    whether either is right. ``answer`` of a problem is its choice's number from 0, ``choices`` how many it has.
    """
    def pick(text: Column) -> Column:
        named = F.regexp_extract_all(text, F.lit("The answer is ([A-Z])."), F.lit(1))
        return F.when(F.size(named) == 1, F.get(named, F.lit(0))).otherwise("FAILED")

    def place(letter: Column) -> Column:
        at = F.array_position(F.array(*[F.lit(x) for x in letters]), letter).cast("int") - 1
        return F.when((at >= 0) & (at < F.col("choices")), at)

    rows = problems.join(own.select("problem_id", pick(F.col("text")).alias("a")), "problem_id").join(other.select("problem_id", pick(F.col("text")).alias("b")), "problem_id")
    mine, theirs = F.coalesce(place(F.col("a")) == F.col("answer"), F.lit(False)), F.coalesce(place(F.col("b")) == F.col("answer"), F.lit(False))
    failed = F.col("b") == "FAILED"
    return rows.select("problem_id", F.when(failed, mine).otherwise(theirs).alias("correct"), (mine | theirs).alias("upper"), failed.alias("failed"))


def answered(questions: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Every question with predicted and correct; one without a prediction counts as FAILED and wrong."""
    rows = questions.join(predictions.select(key, F.col("text").alias("__text")), key, "left")
    return rows.withColumn("predicted", F.coalesce("__text", F.lit("FAILED"))).withColumn("correct", F.col("predicted") == F.col("answer")).drop("__text")


def reviewed_pairs(questions: DataFrame, first: DataFrame, second: DataFrame, contexts: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions with both answers of their place, their image's context and their category's rule, and the categories without a rule."""
    rows = questions.join(first.select("ord", F.col("text").alias("first")), "ord").join(second.select("ord", F.col("text").alias("second")), "ord").join(contexts.select("image", "context"), "image")
    return rows.join(rules.select("category", "rule"), "category"), rows.join(rules, "category", "left_anti").select("category").distinct()
