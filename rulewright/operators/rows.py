"""Rows of training and evaluation files as structs: samples of several shapes, preference pairs, submissions, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.functions import text as T
from rulewright.operators.conversations import training_row
from rulewright.operators.corpus import numbered, preference_pairs


def _truthy(*columns: Column) -> Column:
    """The first column that is neither null nor empty; blanks count as filled."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def training_fields() -> list[Column]:
    """question_id, question, image_id, answer and answer_type of a row, texts without blanks at the ends, the type ``other`` if missing."""
    return [
        F.col("question_id").cast("long").alias("question_id"), T.trimmed(F.col("question")).alias("question"), F.col("image_id").cast("long").alias("image_id"),
        T.trimmed(F.col("answer")).alias("answer"), F.coalesce("answer_type", F.lit("other")).alias("answer_type"),
    ]


def aliased_fields() -> list[Column]:
    """question, answer, image and answer_type from whichever of their names a row has."""
    text = lambda *names: T.trimmed(F.coalesce(_truthy(*[F.col(n) for n in names]), F.lit("")))
    return [
        text("generated_question", "question", "text").alias("question"), text("generated_answer", "answer", "original_answer").alias("answer"),
        F.coalesce(_truthy(F.col("image_path"), F.col("image")), F.lit("")).alias("image"), F.coalesce("answer_type", F.lit("other")).alias("answer_type"),
    ]


def evaluation_fields(dataset: Column) -> list[Column]:
    """question, answer, correct_answer, shortcut_answer, answer_type and eval_dataset; question and answer are null where none is filled."""
    text = lambda *names: T.first_filled(*[F.col(n) for n in names])
    answer = text("answer", "generated_answer")
    return [
        text("question", "generated_question", "text").alias("question"), answer.alias("answer"), answer.alias("correct_answer"), F.coalesce(text("shortcut_answer", "original_answer"), F.lit("")).alias("shortcut_answer"),
        F.coalesce("answer_type", F.lit("")).alias("answer_type"), dataset.alias("eval_dataset"),
    ]


def question_row(marked: bool = False) -> list[Column]:
    """question_id, image (its file) and text of a question, with an image mark before it if ``marked``."""
    text = F.concat(F.lit("<image>\n"), F.col("question")) if marked else F.col("question")
    return [F.col("question_id").cast("long").alias("question_id"), T.image_file(F.col("image_id").cast("long")).alias("image"), text.alias("text")]


def preference_rows(rows: DataFrame, question: str, order: str) -> DataFrame:
    """Preference rows with idx, the place in ``order``, chosen and rejected answers and both as positive and negative structs.

    Rows whose answers are empty or differ in case only, and those without a question, are left out and leave gaps in idx.
    """
    told = numbered(rows, [F.col(order)], "idx").withColumns({c: T.trimmed(F.coalesce(F.col(c), F.lit(""))) for c in ("generated_answer", "original_answer")})
    told = preference_pairs(told.withColumn("__q", T.trimmed(F.coalesce(F.col(question), F.lit("")))).filter("__q <> ''"), "generated_answer", "original_answer", same_case=False)
    image = F.coalesce(F.nullif("source_image", F.lit("")), T.image_file(F.col("image_id")))
    side = lambda c: F.struct(F.col(c).alias("answer"), F.lit(c).alias("source"))
    return told.select(
        F.col("idx"), F.col("question_id"), F.col("image_id"), image.alias("image"), F.col("__q").alias("question"), F.col("answer_type"), F.col("generated_answer").alias("answer"), F.col("original_answer").alias("shortcut_answer"),
        side("generated_answer").alias("positive"), side("original_answer").alias("negative"), F.col("generated_answer").alias("chosen"), F.col("original_answer").alias("rejected"),
    )


def preference_records(rows: DataFrame, root: str, order: str) -> DataFrame:
    """Records of chosen and rejected answers that differ in any letter, numbered without gaps from 0, with the image's path."""
    texts = rows.withColumns({c: T.trimmed(F.coalesce(F.col(c), F.lit(""))) for c in ("question", "chosen", "rejected")}).filter("question <> ''")
    kept = numbered(preference_pairs(texts, "chosen", "rejected", same_case=True), [F.col(order)], "idx")
    path = F.concat(F.lit(root.rstrip("/") + "/"), F.col("image"))
    return kept.select("idx", "question_id", "image_id", "question", "chosen", "rejected", "answer_type", path.alias("image"), path.alias("image_path"), F.coalesce("origin_split", F.lit("train")).alias("origin_split"))


def multimodal_sample(source: Column) -> Column:
    """A sample (question_id, image_id, image, answer_type, data_source, mask_supervision, conversations) from a row of any of three shapes.

    A row with conversations keeps them; one with question and answer, or with generated ones, gets
    the two turns made of them. The image is the given one, else by the image id's file or, for rows of ``source`` gqa
    and vg, its folder.
    """
    plain, made = F.col("question").isNotNull() & F.col("answer").isNotNull(), F.col("generated_question").isNotNull() & F.col("generated_answer").isNotNull()
    given = F.col("conversations").isNotNull()
    turns = lambda q, a: training_row(T.trimmed(F.col(q)), T.trimmed(F.col(a)))
    by_id, number = T.image_file(F.col("image_id")), F.col("image_id").cast("string")
    folder = F.when(source == "gqa", F.concat(F.lit("gqa/images/"), number, F.lit(".jpg"))).when(source == "vg", F.concat(F.lit("vg/"), number, F.lit(".jpg"))).otherwise(F.coalesce("image_path", F.lit("")))
    shape = lambda a, b, c: F.when(given, a).when(plain, b).when(made, c)
    none = F.lit(None).cast("string")
    return F.struct(
        F.coalesce("question_id", F.when(~given, F.lit(-1))).cast("long").alias("question_id"), F.col("image_id"), shape(F.coalesce("image", by_id), by_id, folder).alias("image"),
        shape(F.col("answer_type"), *[F.coalesce("answer_type", F.lit("other"))] * 2).alias("answer_type"), shape(F.coalesce("data_source", none), F.coalesce("data_source", F.lit("vqa")), F.coalesce(F.col("data_source"), source)).alias("data_source"),
        shape(F.col("mask_supervision"), *[F.coalesce("mask_supervision", F.lit(""))] * 2).alias("mask_supervision"),
        shape(F.col("conversations"), turns("question", "answer"), turns("generated_question", "generated_answer")).alias("conversations"),
    )


def preference_sample() -> Column:
    """(prompt, chosen, rejected, image) from a row of any of three shapes: with a prompt, a shortcut answer, or a question and both answers."""
    marked = F.concat(F.lit("<image>\n"), F.col("question"))
    ready, short = F.col("prompt").isNotNull() & F.col("chosen").isNotNull() & F.col("rejected").isNotNull(), F.col("question").isNotNull() & F.col("answer").isNotNull() & F.col("shortcut_answer").isNotNull()
    full = F.col("question").isNotNull() & F.col("chosen").isNotNull() & F.col("rejected").isNotNull()
    pick = lambda a, b, c: F.when(ready, a).when(short, b).when(full, c)
    return F.struct(
        pick(F.col("prompt"), marked, marked).alias("prompt"), pick(F.col("chosen"), F.col("answer"), F.col("chosen")).alias("chosen"), pick(F.col("rejected"), F.col("shortcut_answer"), F.col("rejected")).alias("rejected"),
        F.coalesce(F.col("image"), T.image_file(F.col("image_id"))).alias("image"),
    )


# Roles of conversations by the names of their turns.
ROLES = {"human": "user", "gpt": "assistant"}


def messages(conversation: Column, image: str) -> Column:
    """The turns as (role, content); an image mark with a line break on either side becomes ``image`` between empty lines."""
    roles = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    mark = image.replace("\\", "\\\\").replace("$", "\\$")
    return F.transform(conversation, lambda t: F.struct(F.coalesce(roles[t["from"]], t["from"]).alias("role"), F.regexp_replace(t["value"], "\n?<image>\n?", f"\n\n{mark}\n\n").alias("content")))


def capitalised(text: Column) -> Column:
    """A text without blanks at the ends, its first letter upper case; null is empty."""
    return T.let(F.coalesce(T.trimmed(text), F.lit("")), lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30)))


def file_stem(text: Column, most: int = 80) -> Column:
    """A text as a file name's stem: spaces and runs of other signs as underscores, cut to ``most``; ``empty`` if nothing is left."""
    plain = F.regexp_replace(F.replace(T.trimmed(text), F.lit(" "), F.lit("_")), r"[^0-9a-zA-Z_\-]+", "_")
    return F.when(plain == "", "empty").otherwise(F.substring(plain, 1, most))


def judge_rows(predictions: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(question, llm_output, correct_answer, answer_type) of predictions with an answer, and the ids of those without."""
    own = answers.select("question_id", F.coalesce("answer", F.lit("")).alias("correct_answer"), F.coalesce("answer_type", F.lit("")).alias("answer_type"))
    rows = predictions.join(own, "question_id").select("question_id", "question", capitalised(F.col("text")).alias("llm_output"), "correct_answer", "answer_type")
    return rows, predictions.join(answers, "question_id", "left_anti").select("question_id")


def metric_fields(stats: Column) -> list[Column]:
    """The counts and the accuracy of a judge's statistics (a variant); null where one is missing."""
    return [F.try_variant_get(stats, f"$.stat_info.{n}", "double").alias(n) for n in ("Valid_num", "Correct_num", "Incorrect_num", "Accuracy")]


def answer_submission(questions: DataFrame, predictions: DataFrame, by_image: bool = False) -> DataFrame:
    """(question_id, answer) of all questions with plain answers, empty where nothing was predicted; ``by_image`` gives (image, answer) of those with one."""
    plain = predictions.select("question_id", T.plain_answer(F.col("text")).alias("answer"))
    if by_image:
        return questions.join(plain, "question_id").select("image", "answer")
    return questions.select("question_id").join(plain, "question_id", "left").select("question_id", F.coalesce("answer", F.lit("")).alias("answer"))


def prediction_submission(predictions: DataFrame) -> DataFrame:
    """(questionId, prediction): texts in lower case without periods at the end."""
    return predictions.select(F.col("question_id").alias("questionId"), F.lower(F.regexp_replace("text", r"\.+$", "")).alias("prediction"))


def mapped_submission(predictions: DataFrame) -> DataFrame:
    """(key, text): a text by the id's key with the prefix v1_."""
    return predictions.select(F.concat(F.lit("v1_"), F.col("question_id").cast("string")).alias("key"), "text")


def _stands(text: Column, term: Column) -> Column:
    return F.regexp(text, F.concat(F.lit(r"(^|[^a-z])\Q"), term, F.lit(r"\E([^a-z]|$)")))


def cue_reason(text: Column, cue: Column, aliases: dict[str, list[str]], excluded: dict[str, list[str]]) -> Column:
    """How a text mentions a cue: ``strict_literal_match:`` or ``strict_alias_match:`` with the term, null if not.

    A term stands between other characters than letters. A text that one of the cue's excluded patterns fits mentions nothing.
    """
    low, name = F.lower(text), F.lower(cue)
    lookup = lambda d: F.coalesce(F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])[name] if d else F.lit(None), F.array().cast("array<string>"))
    alias = F.get(F.filter(lookup(aliases), lambda t: _stands(low, t)), F.lit(0))
    out = F.exists(lookup(excluded), lambda p: F.regexp(low, p))
    return F.when(~out, F.when(_stands(low, name), F.concat(F.lit("strict_literal_match:"), name)).when(alias.isNotNull(), F.concat(F.lit("strict_alias_match:"), alias)))


def audited(rows: DataFrame, aliases: dict[str, list[str]], excluded: dict[str, list[str]]) -> DataFrame:
    """Adds cue_results, (cue, mentioned, reason) of each cue, and remove, whether any is mentioned.

    Rows have text, visual_cues and said, an array of (cue, mentioned, reason) from a model; a strict
    mention in the text overrules it, and a cue it left out is not mentioned, for ``missing_from_model_output``.
    """
    said = lambda cue: F.try_element_at(F.filter("said", lambda s: T.trimmed(s["cue"]) == cue), F.lit(-1))

    def one(cue: Column) -> Column:
        own, strict = said(cue), cue_reason(F.col("text"), cue, aliases, excluded)
        reason = F.coalesce(strict, F.when(own.isNotNull(), T.trimmed(F.coalesce(own["reason"], F.lit("")))), F.lit("missing_from_model_output"))
        return F.struct(cue.alias("cue"), (strict.isNotNull() | F.coalesce(own["mentioned"], F.lit(False))).alias("mentioned"), reason.alias("reason"))

    return rows.withColumn("cue_results", F.transform("visual_cues", one)).withColumn("remove", F.exists("cue_results", lambda c: c["mentioned"]))
