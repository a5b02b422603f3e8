"""Short answers chosen as spans of long ones: candidate spans, their features, and the best one of each question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.functions import text as T
from rulewright.operators.joins import large, spread

# Word lists and weights that the choice depends on.
STOPWORDS = [
    "a", "an", "and", "any", "are", "as", "at", "be", "both", "by", "for", "from", "in", "is", "it", "just", "many", "much", "of", "on", "or", "some", "that", "the", "their", "there", "these", "this",
    "those", "to", "which", "while", "with",
]
CLAUSE_WORDS = ["am", "are", "be", "been", "being", "has", "have", "had", "is", "was", "were"]
COLOR_WORDS = [
    "black", "blue", "brown", "gold", "gray", "green", "grey", "orange", "pink", "purple", "red", "silver", "tan", "teal", "white", "yellow", "beige", "maroon", "navy", "rainbow", "blonde",
]
ROOM_PHRASES = ["bathroom", "bedroom", "dining room", "garage", "kitchen", "living room", "office"]
MATERIAL_WORDS = ["brick", "cement", "ceramic", "cloth", "concrete", "glass", "leather", "metal", "paper", "plastic", "stone", "tile", "wood", "wooden"]
LOCATION_WORDS = ["above", "across", "around", "at", "behind", "below", "beneath", "beside", "between", "by", "in", "inside", "near", "next", "off", "on", "outside", "over", "under"]
LOCATION_NOUNS = ["back", "background", "bottom", "center", "centre", "foreground", "front", "left", "middle", "right", "side", "top"]
LOCATION_TAILS = ["on the side", "at the side", "by the side", "to the side", "on side", "at side", "by side"]
EDGE_WORDS = [
    "a", "an", "answer", "choices", "choice", "directly", "given", "here", "image", "letter", "option", "options", "phrase", "photo", "picture", "question", "scene", "shown", "single", "that", "the",
    "there", "these", "this", "those", "using", "visible", "word",
]
CONTEXT_WORDS = ["around", "as", "at", "behind", "beneath", "beside", "between", "by", "during", "for", "from", "in", "inside", "near", "of", "on", "outside", "over", "to", "toward", "under", "with"]
WEAK_STARTS = ["a", "an", "as", "it", "the", "there", "they"]
SAME, OVERLAP = 100.0, 30.0
BY_TYPE = {"yesno": 45.0, "count": 35.0, "color": 30.0, "room": 25.0, "material": 20.0, "location": 30.0}
SAME_CHOICE, SAME_CHOICE_WORD, CHOICE_END, CHOICE_SHARED, CHOICE_SHARED_WORD = 50.0, 5.0, 24.0, 12.0, 4.0
LONG, WORD, STOP_END, WEAK_START, CLAUSE, NEW_WORD, NEW_THEN_ASKED, NOTHING_NEW, ONLY_STOPS = -5.0, -0.35, -18.0, -4.0, -12.0, 4.0, 8.0, -6.0, -25.0
ONLY_ASKED, NO_CHOICE_ASKED, NO_CHOICE, ONLY_LOCATION, TAIL, TAIL_WORD = -16.0, -18.0, -9.0, -28.0, -12.0, -4.0

_NONE = "array<string>"


def _list(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _without(tokens: Column, *lists: list[str]) -> Column:
    """The tokens, repeats too, that are in none of the lists."""
    return F.filter(tokens, lambda t: ~t.isin(*[w for words in lists for w in words]))


def _all_in(tokens: Column, words: list[str]) -> Column:
    return F.forall(tokens, lambda t: t.isin(*words))


def tokens_of(text: Column) -> Column:
    """The lower-case words of a text, with inner apostrophes."""
    return F.regexp_extract_all(T.normalized_answer(text), F.lit("[a-z0-9]+('[a-z0-9]+)?"), F.lit(0))


def canonical(tokens: Column) -> Column:
    """Number words as digits, numbers without leading zeros."""
    return F.transform(tokens, lambda t: F.when(t.rlike("^[0-9]+$"), F.regexp_replace(t, "^0+(?=.)", "")).otherwise(T._lookup(T.NUMBER_WORDS, t)))


def _stripped(tokens: Column) -> Column:
    """Tokens without edge words at the start and without edge and context words at the end."""
    first = F.array_position(F.transform(tokens, lambda t: t.isin(*EDGE_WORDS)), False).cast("int")
    last = F.array_position(F.reverse(F.transform(tokens, lambda t: t.isin(*EDGE_WORDS, *CONTEXT_WORDS))), False).cast("int")
    size = F.size(tokens) - (first - 1) - (last - 1)
    return F.when((first > 0) & (last > 0) & (size > 0), F.slice(tokens, F.greatest(first, F.lit(1)), F.greatest(size, F.lit(0)))).otherwise(F.array().cast(_NONE))


def choice_options(tokens: Column, most: int = 4) -> Column:
    """The options around each "or" of a question: what up to ``most`` words on either side leave without edge and context words.

    Distinct ones of up to ``most`` words, not all stop words, the shorter first, then by their words.
    """
    at = F.filter(F.transform(tokens, lambda t, i: F.when(t == "or", i)), lambda i: i.isNotNull())
    left = lambda i, n: F.slice(tokens, F.greatest(i - n + 1, F.lit(1)), F.least(n, i))
    right = lambda i, n: F.slice(tokens, i + 2, n)
    sizes = lambda n: F.when(n > 0, F.sequence(F.lit(1), F.least(n, F.lit(most)))).otherwise(F.array().cast("array<int>"))
    windows = F.flatten(F.transform(at, lambda i: F.concat(F.transform(sizes(i), lambda n: left(i, n)), F.transform(sizes(F.size(tokens) - i - 1), lambda n: right(i, n)))))
    options = F.filter(F.transform(windows, _stripped), lambda o: (F.size(o) > 0) & (F.size(o) <= most) & ~_all_in(o, STOPWORDS))
    return F.transform(F.array_sort(F.transform(F.array_distinct(options), lambda o: F.named_struct(F.lit("n"), F.size(o), F.lit("o"), o))), lambda x: x["o"])


def choice_score(span: Column, options: Column) -> Column:
    """How well a span fits one of the options, both canonical: all of it, its beginning or end, or two shared content words."""
    n = F.size(span)
    own = F.array_distinct(_without(span, STOPWORDS))
    ends = lambda o: (n >= 2) & (F.size(o) >= n) & ((F.slice(o, F.lit(1), n) == span) | (F.slice(F.reverse(o), F.lit(1), n) == F.reverse(span)))
    shared = lambda o: F.size(F.array_intersect(own, _without(o, STOPWORDS)))
    one = lambda o: F.greatest(F.when(ends(o), CHOICE_END).otherwise(0.0), F.when(shared(o) >= 2, CHOICE_SHARED + CHOICE_SHARED_WORD * shared(o)).otherwise(0.0))
    same = F.exists(options, lambda o: o == span)
    return F.when(n == 0, 0.0).when(same, SAME_CHOICE + SAME_CHOICE_WORD * n).otherwise(F.coalesce(F.array_max(F.transform(options, one)), F.lit(0.0)))


def _numeric_place(tokens: Column) -> Column:
    """A number followed by words of place alone, such as "2 on the left"."""
    rest = _without(F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), STOPWORDS)
    return (F.size(tokens) >= 2) & F.get(tokens, F.lit(0)).rlike("^[0-9]+$") & (F.size(rest) > 0) & _all_in(rest, LOCATION_WORDS + LOCATION_NOUNS)


def answer_spans(tokens: Column, most: int) -> Column:
    """The distinct runs of at most ``most`` tokens, by start and then length, but none of stop words or of a number and its place."""
    places = F.when(F.size(tokens) > 0, F.sequence(F.lit(1), F.size(tokens))).otherwise(F.array().cast("array<int>"))
    runs = F.flatten(F.transform(places, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size(tokens) - i + 1)), lambda n: F.slice(tokens, i, n))))
    return F.array_distinct(F.filter(runs, lambda r: ~_all_in(r, STOPWORDS) & ~_numeric_place(r)))


def span_flags(tokens: Column) -> Column:
    """(is_yesno, is_number, is_color, is_room, is_material) of a span."""
    text, bare = F.array_join(tokens, " "), canonical(tokens)
    return F.struct(
        text.isin("yes", "no").alias("is_yesno"), F.forall(bare, lambda t: t.rlike("^[0-9]+$")).alias("is_number"),
        (_all_in(tokens, [*COLOR_WORDS, "and"]) & F.arrays_overlap(tokens, _list(COLOR_WORDS))).alias("is_color"), text.isin(*ROOM_PHRASES).alias("is_room"), F.arrays_overlap(tokens, _list(MATERIAL_WORDS)).alias("is_material"),
    )


def _tail_words(tokens: Column) -> Column:
    """The length of the place that a span ends with, where something else is said before; 0 if it ends with none."""
    out = F.lit(0)
    for tail in reversed(LOCATION_TAILS):
        n = len(tail.split())
        before = _without(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - n, F.lit(0))), STOPWORDS, CLAUSE_WORDS)
        fits = (F.size(tokens) > n) & (F.array_join(F.slice(tokens, F.greatest(F.size(tokens) - n + 1, F.lit(1)), F.lit(n)), " ") == tail) & (F.size(before) > 0)
        out = F.when(fits, n).otherwise(out)
    return out


def scored_spans(rows: DataFrame, key: str, most: int) -> DataFrame:
    """A row for each question and span: key, place, span, kind (the question's), same, score.

    ``rows`` has the key, question, answer and said, a model's short answer. A span's score is a sum of weights: for agreeing with
    what was said, with the question's kind and options and for new words, less for length and empty ends.
    """
    question = T.normalized_answer(F.col("question"))
    told = spread(rows, key).select(key, question.alias("q"), tokens_of(F.col("question")).alias("asked"), tokens_of(F.col("said")).alias("said"), answer_spans(tokens_of(F.col("answer")), most).alias("spans"))
    # what holds for all spans of a question is made before they part
    told = told.select(key, "asked", "said", canonical(F.col("said")).alias("s"), T.question_type(F.col("q")).alias("kind"), F.transform(choice_options(F.col("asked")), canonical).alias("options"), "spans")
    told = told.select(key, "asked", "said", "s", "kind", "options", F.posexplode("spans").alias("place", "span"))
    told = told.withColumns({"c": canonical(F.col("span")), "flags": span_flags(F.col("span"))})
    span, asked, kind, last, first = F.col("span"), F.col("asked"), F.col("kind"), F.element_at("span", -1), F.element_at("span", 1)
    n = F.size(span)
    same = (F.size("said") > 0) & (F.size("said") <= most) & ((span == F.col("said")) | (F.col("c") == F.col("s")))
    content = _without(span, STOPWORDS, CLAUSE_WORDS)
    new = F.filter(content, lambda t: ~F.array_contains(asked, t))
    all_asked = (F.size(content) > 0) & F.forall(content, lambda t: F.array_contains(asked, t))
    fit = F.when(kind == "choice", choice_score(F.col("c"), F.col("options"))).otherwise(0.0)
    told = told.withColumns({"same": same, "content": content, "new": new, "all_asked": all_asked, "fit": fit, "tail": _tail_words(span)})
    flag = lambda f: F.col(f"flags.is_{f}")
    by_kind = F.lit(0.0)
    for name, is_it in (("yesno", flag("yesno")), ("count", flag("number")), ("color", flag("color")), ("room", flag("room")), ("material", flag("material")), ("location", first.isin(*LOCATION_WORDS))):
        by_kind = F.when((kind == name) & is_it, BY_TYPE[name]).otherwise(by_kind)
    when = lambda c, w: F.when(c, w).otherwise(0.0)
    lost = (kind == "choice") & (F.size("options") > 0) & (F.col("fit") <= 0)
    parts = [
        when(F.col("same"), SAME), when(F.size("said") > 0, OVERLAP * T.overlap_f1(F.col("c"), F.col("s"))), by_kind, F.col("fit"), when(n > 4, LONG), WORD * n, when(last.isin(*STOPWORDS), STOP_END),
        when(first.isin(*WEAK_STARTS), WEAK_START), when(F.arrays_overlap(span, _list(CLAUSE_WORDS)), CLAUSE), NEW_WORD * F.size("new"),
        when((F.size("new") > 0) & F.array_contains(asked, last) & ~last.isin(*STOPWORDS), NEW_THEN_ASKED), when((F.size("new") == 0) & ~_all_in(span, STOPWORDS), NOTHING_NEW), when(_all_in(span, STOPWORDS), ONLY_STOPS),
        when((F.size("content") >= 2) & F.col("all_asked"), ONLY_ASKED), when(lost, F.when(F.col("all_asked"), NO_CHOICE_ASKED).otherwise(NO_CHOICE)),
        when((kind != "location") & (F.size("content") > 0) & _all_in(F.col("content"), LOCATION_WORDS + LOCATION_NOUNS), ONLY_LOCATION), when((kind != "location") & (F.col("tail") > 0), TAIL + TAIL_WORD * F.col("tail")),
    ]
    return told.select(key, "place", F.array_join("span", " ").alias("span"), "kind", "same", sum(parts[1:], parts[0]).alias("score"))


def chosen_spans(rows: DataFrame, key: str, most: int = 4) -> DataFrame:
    """(key, short_answer, method, score): the best span of each answer, the first of equal ones.

    The method is ``aligned_exact`` where it is what was said, else ``aligned_`` with the question's kind, or
    ``aligned_overlap`` for others. An answer without a span stands whole, as ``fallback_full_answer``.
    """
    best = scored_spans(rows, key, most).groupBy(key).agg(F.max_by(F.struct("span", "kind", "same", "score"), F.struct("score", -F.col("place"))).alias("x"))
    method = F.when(F.col("x.same"), "aligned_exact").when(F.col("x.kind") != "other", F.concat(F.lit("aligned_"), F.col("x.kind"))).otherwise("aligned_overlap")
    found = best.select(key, F.col("x.span").alias("short_answer"), method.alias("method"), F.col("x.score").alias("score"))
    whole = large(rows).select(key, T.normalized_answer(F.col("answer")).alias("__whole"))
    return whole.join(large(found), key, "left").select(key, F.coalesce("short_answer", "__whole").alias("short_answer"), F.coalesce("method", F.lit("fallback_full_answer")).alias("method"), F.coalesce("score", F.lit(0.0)).alias("score"))


def compressed_answers(rows: DataFrame, shard: int = 0, shards: int = 1, most: int = 4, regions: bool = False, boxes: bool = False) -> DataFrame:
    """The rows of an answer compression: each question with its chosen span, or skipped with a score of -1.

    ``rows`` has global_index, question_id, image_id, question, answer and said. Questions for a region's description are skipped unless
    ``regions``, those for a box's coordinates unless ``boxes``; they stay with an empty short answer.
    """
    own = rows.filter(F.col("global_index") % shards == shard).withColumn("question_family", T.question_family(T.normalized_answer(F.col("question"))))
    skip = ((F.col("question_family") == "region_desc") & F.lit(not regions)) | ((F.col("question_family") == "bbox_coord") & F.lit(not boxes))
    told = chosen_spans(own.filter(~skip), "global_index", most)
    joined = large(own).join(large(told), "global_index", "left")
    return joined.select(
        "global_index", "question_id", "image_id", "question", "answer", F.when(skip, "").otherwise(T.normalized_answer(F.col("said"))).alias("model_output"), F.coalesce("short_answer", F.lit("")).alias("short_answer"),
        F.coalesce("method", F.concat(F.lit("skipped_"), F.col("question_family"))).alias("selection_method"), F.coalesce("score", F.lit(-1.0)).alias("selection_score"), "question_family", F.lit(shard).alias("shard_id"), F.lit(shards).alias("num_shards"),
    )


def usable_answers(rows: DataFrame, least: float) -> DataFrame:
    """Compressed rows that score ``least`` or more and have a short answer; a missing score counts as 0."""
    return rows.filter((F.coalesce("selection_score", F.lit(0.0)) >= least) & (T.normalized_answer(F.col("short_answer")) != ""))
