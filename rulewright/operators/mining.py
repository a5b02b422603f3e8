"""Association rules with a given answer: baskets, frequent itemsets, rules, pruning and matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulewright.functions import text as T
from rulewright.operators.joins import BROADCAST_ROWS, counted, large, spread
from rulewright.sources.staging import staged

CUE = "V_"


def baskets(items: DataFrame, answers: DataFrame, key: str, item: str = "item", answer: str = "answer") -> DataFrame:
    """(key, items, answer): the sorted distinct items of each key that has an answer and an item.

    A row of ``items`` has one item, or several as an array. Rows that are dealt out by key already (``spread``) aren't shuffled again.
    """
    sets = items.filter(F.col(item).isNotNull()).groupBy(key).agg(F.collect_set(item).alias("items"))
    if items.schema[item].dataType.typeName() == "array":
        sets = sets.withColumn("items", F.array_distinct(F.filter(F.flatten("items"), lambda x: x.isNotNull()))).filter(F.size("items") > 0)
    sets = sets.withColumn("items", F.array_sort("items"))
    return sets.join(large(answers).select(key, F.col(answer).alias("answer")).filter("answer is not null and answer <> ''"), key)


def item_counts(transactions: DataFrame) -> DataFrame:
    """In how many baskets each item stands: item, n."""
    return transactions.select(F.explode(F.array_distinct("items")).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(counts: DataFrame, least: int, top: int | None = None) -> DataFrame:
    """Items counted at least ``least`` times, and of these at most the ``top`` most frequent ones (ties by name)."""
    kept = counts.filter(F.col("n") >= least)
    return kept.orderBy(F.col("n").desc(), "item").limit(top) if top else kept


def rules(transactions: DataFrame, key: str, least: int, longest: int, confidence: float, empty: bool = False) -> DataFrame:
    """Rules itemset -> answer: itemset, answer, n_items, n_both, confidence.

    A rule holds at most ``longest`` items, its answer among them, and at least ``least`` baskets
    have all of them. The search goes level by level: a basket passes to the next level with each
    itemset that is frequent with some answer, extended by a later item that is frequent itself.
    ``transactions`` are read at each level, so stage them first.
    """
    found = []
    if empty:
        whole = transactions.agg(F.count(F.lit(1)).alias("n_items"))
        by_answer = transactions.groupBy("answer").agg(F.count(F.lit(1)).alias("n_both"))
        found.append(by_answer.crossJoin(F.broadcast(whole)).select(F.array().cast("array<string>").alias("itemset"), "answer", "n_items", "n_both"))
    single = staged(transactions.select("answer", F.explode("items").alias("item")).groupBy("item", "answer").agg(F.count(F.lit(1)).alias("n_both")))
    frequent = single.filter(F.col("n_both") >= least).select("item").distinct()
    both = single.join(frequent, "item").select(F.array("item").alias("itemset"), "answer", "n_both")
    # a row for each basket and frequent itemset in it, with the items that come after: no level needs the baskets again;
    # items of itemsets go by their numbers in order of names, which are less to compare
    coded = staged(frequent.withColumn("code", F.row_number().over(Window.orderBy("item"))))
    if coded.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        # numbers are looked up as items are taken, so no basket is shuffled
        own, numbers = transactions.select("answer", F.sort_array("items").alias("rest")), F.broadcast(coded)
    else:
        items = transactions.select(key, "answer", F.explode("items").alias("item")).join(large(coded), "item")
        own, numbers = items.groupBy(key, "answer").agg(F.array_sort(F.collect_list("code")).alias("rest")), None
    level = _extended(own.withColumn("itemset", F.array().cast("array<int>")), numbers)
    for size in range(1, longest):
        if size > 1:
            both = staged(level.groupBy("itemset", "answer").agg(F.count(F.lit(1)).alias("n_both")))
        alone = both.groupBy("itemset").agg(F.sum("n_both").alias("n_items"), F.max("n_both").alias("most")).filter(F.col("most") >= least)
        mined = both.filter(F.col("n_both") >= least).join(alone.drop("most"), "itemset").select("itemset", "answer", "n_items", "n_both")
        found.append(mined if size == 1 else _named(mined, coded))
        if size + 1 < longest:
            going = level if size == 1 else level.join(counted(alone.select("itemset")), "itemset")
            level = _extended(going.filter(F.size("rest") > 0), numbers)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.withColumn("confidence", F.col("n_both") / F.col("n_items")).filter(F.col("confidence") >= confidence)


def _extended(level: DataFrame, numbers: DataFrame | None) -> DataFrame:
    """(answer, itemset, rest): each itemset with each item of its rest, and what comes after that one.

    Items of the rest are names that get their ``numbers``, those without one are left out; or numbers already.
    """
    each = level.select("answer", "itemset", F.posexplode("rest").alias("at", "code" if numbers is None else "item"), "rest")
    each = each if numbers is None else each.join(numbers, "item")
    return each.select("answer", F.concat("itemset", F.array("code")).alias("itemset"), F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"))


def _named(mined: DataFrame, coded: DataFrame) -> DataFrame:
    """Rules of numbered items with the items (item, code) themselves."""
    each = mined.select("answer", "n_items", "n_both", "itemset", F.explode("itemset").alias("code")).join(coded, "code")
    rows = each.groupBy("itemset", "answer", "n_items", "n_both").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return rows.select(F.col("items").alias("itemset"), "answer", "n_items", "n_both")


#: The orders in which rules are ranked: by confidence and support, with different ties, or by support first.
ORDERS = {
    "items": lambda: [F.col("confidence").desc(), F.col("n_items").desc(), F.size("itemset"), "answer", "itemset"],
    "name": lambda: [F.col("confidence").desc(), F.col("n_items").desc(), F.concat_ws(" ", "answer", F.array_join("itemset", " "))],
    "length": lambda: [F.col("confidence").desc(), F.col("n_items").desc(), F.size("itemset").desc(), "itemset", "answer"],
    "support": lambda: [F.col("n_items").desc(), F.col("confidence").desc(), "itemset", "answer"],
}


def ranked(mined: DataFrame, order: str = "items") -> DataFrame:
    """Adds rank in one of ORDERS: confidence and support (n_items) falling, then by fewer items, by name or by more items; or support first."""
    return mined.withColumn("rank", F.row_number().over(Window.orderBy(*ORDERS[order]())))


def best_rules(mined: DataFrame, most: int, order: str = "items") -> DataFrame:
    """The ``most`` first rules in one of ORDERS, with rank; all of them for 0 or less."""
    rules = ranked(mined, order)
    return rules.filter(F.col("rank") <= most) if most > 0 else rules


def with_cue(mined: DataFrame) -> DataFrame:
    """The rules that have a visual cue."""
    return mined.filter(F.exists("itemset", lambda x: x.startswith(CUE)))


def rule_rows(mined: DataFrame) -> DataFrame:
    """Adds to rules text_keywords, visual_cues (without their mark) and trigger, the keywords joined by spaces."""
    named = mined.withColumns({"text_keywords": keywords(F.col("itemset")), "visual_cues": F.transform(cues(F.col("itemset")), lambda x: F.substring(x, len(CUE) + 1, 1 << 30))})
    return named.withColumn("trigger", F.array_join("text_keywords", " "))


def answer_candidates(rows: DataFrame, key: str, text: str, answers: DataFrame, most: int = 16) -> DataFrame:
    """(key, answer): the known answers that a text is or holds as a run of tokens, at most the ``most`` of least answer_id.

    ``answers`` has answer and answer_id. Tokens are lower-case letters and digits, apostrophes stand
    alone; runs are as long as the longest known answer has words. Rows are dealt out by key, however few bytes their
    file has, and shuffled once; if they have few different texts, each of these is looked through once.
    """
    own, kinds = spread(rows.select(key, text), key), rows.select(text).distinct()
    if kinds.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        found = own.join(counted(staged(_said(kinds, text, text, answers).distinct())), text)
    else:
        found = _said(own, key, text, answers)
    found = found.groupBy(key).agg(F.slice(F.array_sort(F.collect_set(F.struct("answer_id", "answer"))), 1, most).alias("__found"))
    return found.select(key, F.explode("__found").alias("x")).select(key, F.col("x.answer").alias("answer"))


def _said(rows: DataFrame, key: str, text: str, answers: DataFrame) -> DataFrame:
    """(key, answer_id, answer) of the known answers that a text is or holds."""
    plain = T.normalized_answer(F.col(text))
    longest = answers.agg(F.coalesce(F.max(F.size(F.split("answer", " "))), F.lit(0)).alias("__most"))
    tokens = rows.select(key, plain.alias("__plain"), F.regexp_extract_all(plain, F.lit("[a-z0-9]+|'"), F.lit(0)).alias("__w")).crossJoin(F.broadcast(longest))
    none = F.array().cast("array<string>")
    upto = lambda i: F.least(F.col("__most"), F.size("__w") - i + 1)
    at = lambda i: F.when(upto(i) > 0, F.transform(F.sequence(F.lit(1), upto(i)), lambda n: F.array_join(F.slice("__w", i, n), " "))).otherwise(none)
    runs = F.when(F.size("__w") > 0, F.flatten(F.transform(F.sequence(F.lit(1), F.size("__w")), at))).otherwise(none)
    said = tokens.select(key, F.explode(F.array_distinct(F.concat(F.array("__plain"), runs))).alias("answer"))
    return said.join(counted(answers.select("answer", "answer_id")), "answer").select(key, "answer_id", "answer")


def lowest_keywords(rows: DataFrame, key: str, tokens: str, known: DataFrame, most: int = 64) -> DataFrame:
    """(key, keywords): the known tokens of each row, at most the ``most`` of least keyword_id, in that order.

    ``known`` has keyword and keyword_id. Rows without a known token are left out.
    """
    each = rows.select(key, F.explode(F.array_distinct(tokens)).alias("keyword")).join(known.select("keyword", "keyword_id"), "keyword")
    sets = each.groupBy(key).agg(F.slice(F.array_sort(F.collect_set(F.struct("keyword_id", "keyword"))), 1, most).alias("x"))
    return sets.select(key, F.transform("x", lambda k: k["keyword"]).alias("keywords"))


def with_candidates(transactions: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """A basket for each answer candidate: (key, items, answer), for ``match_any_cue``."""
    return large(transactions).drop("answer").join(large(candidates).select(key, "answer"), key)


def _subsets(itemset: Column, size: int) -> Column:
    """All proper subsets of an array of ``size`` items, in its order."""
    masks = F.sequence(F.lit(0), F.lit((1 << size) - 2)) if size else F.array().cast("array<int>")
    return F.transform(masks, lambda mask: F.filter(itemset, lambda _, i: F.pmod(F.floor(mask / F.pow(F.lit(2.0), i)), F.lit(2)) == 1))


def without_redundant(mined: DataFrame, longest: int) -> DataFrame:
    """Keeps one rule for each itemset, and none that a kept rule of better rank makes redundant.

    That is a kept rule with the same answer and a proper subset of the items. The greedy pass in
    the order of ranks is done size by size: smaller itemsets are settled before larger ones.
    """
    mined, kept = staged(mined), None
    for size in range(longest):
        level = mined.filter(F.size("itemset") == size)
        if kept is not None:
            below = level.select("rank", "answer", F.explode(_subsets(F.col("itemset"), size)).alias("part"))
            better = kept.select(F.col("answer").alias("a"), F.col("itemset").alias("part"), F.col("rank").alias("r"))
            redundant = below.join(better, (below["answer"] == better["a"]) & (below["part"] == better["part"]) & (F.col("r") < F.col("rank"))).select("rank").distinct()
            level = level.join(redundant, "rank", "left_anti")
        best = Window.partitionBy("itemset").orderBy("rank")
        level = staged(level.withColumn("__n", F.row_number().over(best)).filter("__n = 1").drop("__n"))
        kept = level if kept is None else kept.unionByName(level)
    return kept


def cues(itemset: Column) -> Column:
    return F.filter(itemset, lambda x: x.startswith(CUE))


def keywords(itemset: Column) -> Column:
    return F.filter(itemset, lambda x: ~x.startswith(CUE))


def _held(part: str, items: str) -> Column:
    """Whether all of an array's items are in another: its first and last one, and only for longer arrays all of them, are looked for."""
    n = F.size(part)
    some = F.array_contains(items, F.get(part, F.lit(0))) & F.array_contains(items, F.get(part, n - 1))
    return (n == 0) | (some & ((n <= 2) | (F.size(F.array_except(part, items)) == 0)))


def _any(part: str, items: str) -> Column:
    """Whether any of an array's items is in another; its first one is looked for before the others."""
    return F.coalesce(F.array_contains(items, F.get(part, F.lit(0))) | ((F.size(part) > 1) & F.arrays_overlap(part, items)), F.lit(False))


def _anchored(split: DataFrame, items: str, counts: DataFrame) -> DataFrame:
    """Adds item, the one of a rule's ``items`` that the fewest baskets have (ties by name); rules without any are left out."""
    parts = split.select("rank", F.explode(items).alias("item")).join(counts, "item", "left")
    rarest = parts.groupBy("rank").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "item"))["item"].alias("item"))
    return large(split).join(rarest, "rank")


def match_any_cue(transactions: DataFrame, mined: DataFrame, key: str, bare: bool = False) -> DataFrame:
    """(key, rank) of the best rule of each basket: its answer, any of its cues and all its keywords are there.

    Rules without cues match nothing, or with ``bare`` by their keywords alone. A basket meets a
    rule by its answer and a cue, or by its answer and the rule's rarest keyword, all in one pass; of the rules
    that have neither cue nor keyword only the best of each answer can be a basket's best.
    """
    split = mined.select("rank", "answer", cues(F.col("itemset")).alias("cues"), keywords(F.col("itemset")).alias("words"))
    own = large(transactions).select(key, "answer", "items")
    known = split.select("rank", F.col("answer").alias("of"), "words", F.explode("cues").alias("by"))
    if bare:
        plain = split.filter(F.size("cues") == 0).drop("cues")
        worded = _anchored(plain.filter(F.size("words") > 0), "words", item_counts(transactions))
        known = known.unionByName(worded.withColumnsRenamed({"answer": "of", "item": "by"}))
        # each basket has its answer's best rule without items from the start
        best = plain.filter(F.size("words") == 0).groupBy("answer").agg(F.min("rank").alias("least"))
        own = own.join(counted(best), "answer", "left")
    each = own.withColumn("item", F.explode_outer("items") if bare else F.explode(cues(F.col("items"))))
    fits = (F.col("answer") == F.col("of")) & (F.col("item") == F.col("by")) & _held("words", "items")
    met = each.join(counted(staged(known)), fits, "left" if bare else "inner")
    found = met.groupBy(key).agg(F.min(F.least("rank", "least") if bare else "rank").alias("rank"))
    return found.filter("rank is not null")


def match_all_items(transactions: DataFrame, mined: DataFrame, key: str, any_cue: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """(key, rank, correct) of all rules whose items all stand in the basket; an empty itemset is in every basket.

    The columns ``carried`` of the baskets come along.
    With ``any_cue`` all keywords and, where a rule has cues, any one of them are enough. Rules are
    found by their rarest item (ties by name), or by their rarest keyword, so that a basket meets few rules. A rule
    of cues alone is found by each of them, and counts at the first that the basket has, so no match is shuffled.
    """
    known = mined.select("rank", "itemset", F.col("answer").alias("consequent"))
    columns = [key, "rank", (F.col("answer") == F.col("consequent")).alias("correct"), *carried]
    own = large(transactions).select(key, "answer", "items", *carried)
    each = own.withColumn("item", F.explode(F.array_distinct("items")))
    always = own.crossJoin(F.broadcast(known.filter(F.size("itemset") == 0)))
    if any_cue:
        none = F.array().cast("array<string>")
        split = known.select("rank", "consequent", keywords(F.col("itemset")).alias("words"), cues(F.col("itemset")).alias("some"))
        worded = _anchored(split.filter(F.size("words") > 0), "words", item_counts(transactions)).withColumn("before", none)
        cued = split.filter(F.size("words") == 0).select("rank", "consequent", "words", none.alias("some"), F.posexplode("some").alias("at", "item"), F.slice("some", 1, F.col("at")).alias("before"))
        rules = worded.unionByName(cued.drop("at"))
        fits = _held("words", "items") & ((F.size("some") == 0) | _any("some", "items")) & ((F.size("before") == 0) | ~_any("before", "items"))
    else:
        rules, fits = _anchored(known, "itemset", item_counts(transactions)), _held("itemset", "items")
    return each.join(counted(staged(rules)), "item").filter(fits).select(*columns).unionByName(always.select(*columns))


def dilution(matches: DataFrame, groups: DataFrame, key: str, group: str) -> DataFrame:
    """Active and correct baskets of each rule, by group and in all (null group): rank, group, active, positive."""
    return diluted(matches.join(large(groups).select(key, F.col(group).alias("group")), key), "group")


def diluted(matches: DataFrame, group: str) -> DataFrame:
    """As ``dilution`` of matches that carry their group: they are summed where they are made, and none is shuffled."""
    own = matches.groupBy("rank", F.col(group).alias("group")).agg(F.count(F.lit(1)).alias("active"), F.sum(F.col("correct").cast("long")).alias("positive"))
    sums = own.groupingSets([["rank", "group"], ["rank"]], "rank", "group").agg(F.sum("active").alias("active"), F.sum("positive").alias("positive"))
    return sums.select("rank", "group", "active", "positive")


def match_stages(transactions: DataFrame, mined: DataFrame, key: str) -> DataFrame:
    """(key, stage): how far each basket comes: ``no answer`` with rules, ``no candidate`` by a cue, ``no match``, or ``matched``."""
    known = mined.select("answer").distinct().withColumn("__known", F.lit(True))
    pairs = mined.select("answer", F.explode(cues(F.col("itemset"))).alias("cue")).distinct()
    own = transactions.select(key, "answer", F.explode(cues(F.col("items"))).alias("cue"))
    cued = own.join(pairs, ["answer", "cue"], "left_semi").select(key).distinct().withColumn("__cued", F.lit(True))
    met = match_any_cue(transactions, mined, key).select(key, F.lit(True).alias("__met"))
    told = transactions.select(key, "answer").join(known, "answer", "left").join(cued, key, "left").join(met, key, "left")
    stage = F.when(F.col("__known").isNull(), "no answer").when(F.col("__cued").isNull(), "no candidate").when(F.col("__met").isNull(), "no match").otherwise("matched")
    return told.select(key, stage.alias("stage"))
