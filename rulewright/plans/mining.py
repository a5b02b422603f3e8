"""Rule mining over orders: items are the types (cues) and brands of an order's parts, the answer is its priority."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.operators import corpus, mining
from rulewright.operators.joins import counted, hashed, large, spread
from rulewright.plans.catalog import query
from rulewright.sources.staging import staged
from rulewright.sources.tables import table

LEAST, LONGEST, CONFIDENCE = 25, 3, 0.2


def order_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, items, answer) of each order with lines.

    Many parts have the same items: lines are dealt out to their orders with the number of these, and get the items there.
    """
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.array(F.concat(F.lit(mining.CUE), "p_type"), F.col("p_brand")).alias("item"))
    kinds = counted(staged(parts.select("item").distinct().withColumn("kind", F.monotonically_increasing_id())))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    told = lines.join(hashed(parts.join(kinds, "item").select("l_partkey", "kind")), "l_partkey").select("o_orderkey", "kind")
    items = spread(told, "o_orderkey", count=lines.count()).join(kinds, "kind").select("o_orderkey", "item")
    return mining.baskets(items, table(spark, sf_dir, "orders"), "o_orderkey", answer="o_orderpriority")


def order_rules(own: DataFrame, empty: bool = True) -> DataFrame:
    """The ranked rules of staged baskets."""
    return mining.ranked(mining.rules(own, "o_orderkey", LEAST, LONGEST, CONFIDENCE, empty))


def baskets_and_rules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The baskets and their rules, each computed once."""
    own = staged(order_baskets(spark, sf_dir))
    return own, staged(order_rules(own))


_ITEMS = """
    t AS (SELECT DISTINCT o_orderkey AS k, o_orderpriority AS answer, unnest(['V_' || p_type, p_brand]) AS item
          FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey)"""
_RULES = (
    "WITH"
    + _ITEMS
    + f""",
    b AS (SELECT DISTINCT k, answer FROM t),
    x AS (SELECT k, answer, []::VARCHAR[] AS itemset FROM b UNION ALL SELECT k, answer, [item] FROM t
          UNION ALL SELECT l.k, l.answer, [l.item, r.item] FROM t l JOIN t r ON l.k = r.k AND l.item < r.item),
    both_ AS (SELECT itemset, answer, count(*) AS n_both FROM x GROUP BY ALL),
    alone AS (SELECT itemset, sum(n_both)::BIGINT AS n_items FROM both_ GROUP BY ALL),
    m AS (SELECT itemset, answer, n_items, n_both, n_both / n_items AS confidence FROM both_ JOIN alone USING (itemset)
          WHERE (n_both >= {LEAST} OR len(itemset) = 0) AND n_both / n_items >= {CONFIDENCE}),
    r AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, n_items DESC, len(itemset), answer, itemset)::INT AS rank FROM m)"""
)
_PRUNED = (
    _RULES
    + """,
    k0 AS (SELECT * FROM r WHERE len(itemset) = 0 ORDER BY rank LIMIT 1),
    k1 AS (SELECT r.* FROM r WHERE len(itemset) = 1 AND NOT EXISTS (SELECT 1 FROM k0 WHERE k0.answer = r.answer AND k0.rank < r.rank)
           QUALIFY row_number() OVER (PARTITION BY itemset ORDER BY rank) = 1),
    k2 AS (SELECT r.* FROM r WHERE len(itemset) = 2
           AND NOT EXISTS (SELECT 1 FROM k0 WHERE k0.answer = r.answer AND k0.rank < r.rank)
           AND NOT EXISTS (SELECT 1 FROM k1 WHERE k1.answer = r.answer AND k1.rank < r.rank AND list_contains(r.itemset, k1.itemset[1]))
           QUALIFY row_number() OVER (PARTITION BY itemset ORDER BY rank) = 1),
    p AS (SELECT * FROM k0 UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2)"""
)


def _rows(found: DataFrame) -> DataFrame:
    return found.select(F.array_join("itemset", "|").alias("itemset"), "answer", "n_items", "n_both", F.round("confidence", 9).alias("confidence"), "rank")


_SELECT = "SELECT array_to_string(itemset, '|') AS itemset, answer, n_items, n_both, round(confidence, 9) AS confidence, rank FROM "


@query(_RULES + _SELECT + "r")
def q1_rule_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules with support and confidence, ranked."""
    return _rows(order_rules(staged(order_baskets(spark, sf_dir))))


@query(_PRUNED + _SELECT + "p")
def q2_rule_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules without redundant supersets."""
    return _rows(mining.without_redundant(baskets_and_rules(spark, sf_dir)[1], LONGEST))


@query("WITH" + _ITEMS + " SELECT item, count(*) AS n FROM t GROUP BY item HAVING count(*) >= 100 ORDER BY n DESC, item LIMIT 20")
def q3_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent items."""
    return mining.vocabulary(mining.item_counts(order_baskets(spark, sf_dir)), 100, 20)


_MATCH = """ SELECT o.k AS o_orderkey, min(r.rank) AS rank FROM r JOIN (SELECT k, answer, list(item) AS items FROM t GROUP BY ALL) o ON o.answer = r.answer
    AND len(list_filter(r.itemset, lambda i: NOT starts_with(i, 'V_') AND NOT list_contains(o.items, i))) = 0
    WHERE {cues} GROUP BY o.k"""
_ANY = "len(list_filter(r.itemset, lambda i: starts_with(i, 'V_') AND list_contains(o.items, i))) > 0"


@query(_RULES + _MATCH.format(cues=_ANY))
def q4_match_any_cue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rule of each order, by any cue and all keywords."""
    return mining.match_any_cue(*baskets_and_rules(spark, sf_dir), "o_orderkey")


@query(_RULES + _MATCH.format(cues=f"({_ANY} OR len(list_filter(r.itemset, lambda i: starts_with(i, 'V_'))) = 0)"))
def q5_match_bare_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rule of each order, rules without cues included."""
    return mining.match_any_cue(*baskets_and_rules(spark, sf_dir), "o_orderkey", bare=True)


_ALL = """, o AS (SELECT k, answer, list(item) AS items FROM t GROUP BY ALL),
    hit AS (SELECT o.k, p.rank, p.answer = o.answer AS correct FROM p JOIN o ON len(list_filter(p.itemset, lambda i: NOT list_contains(o.items, i))) = 0)"""


@query(_PRUNED + _ALL + " SELECT rank, count(*) AS active, sum(correct::INT)::BIGINT AS positive FROM hit GROUP BY rank")
def q6_match_all_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that hold all items of a pruned rule, and those of them with its answer."""
    own, rules = baskets_and_rules(spark, sf_dir)
    hits = mining.match_all_items(own, mining.without_redundant(rules, LONGEST), "o_orderkey")
    return hits.groupBy("rank").agg(F.count(F.lit(1)).alias("active"), F.sum(F.col("correct").cast("long")).alias("positive"))


@query(
    _PRUNED
    + _ALL
    + """, c AS (SELECT rank, o_orderstatus AS dataset, count(*) AS active, sum(correct::INT)::BIGINT AS positive FROM hit JOIN orders ON o_orderkey = hit.k GROUP BY GROUPING SETS ((rank, o_orderstatus), (rank))),
    base AS (SELECT o_orderstatus AS dataset, answer, count(*) AS n, sum(count(*)) OVER (PARTITION BY o_orderstatus) AS of FROM b JOIN orders ON o_orderkey = b.k GROUP BY 1, 2
             UNION ALL SELECT NULL, answer, count(*), (SELECT count(*) FROM b) FROM b GROUP BY 2)
    SELECT c.rank, c.dataset, active, positive, round(positive / active / (n / of), 6) AS lift
    FROM c JOIN p USING (rank) JOIN base ON base.answer = p.answer AND base.dataset IS NOT DISTINCT FROM c.dataset"""
)
def q7_rule_dilution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active and correct orders and the lift of each pruned rule, by order status and in all."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    own, rules = baskets_and_rules(spark, sf_dir)
    kept = mining.without_redundant(rules, LONGEST)
    # an order has very many matches, so it takes its status along
    told = staged(large(own).join(orders, "o_orderkey"))
    active = mining.diluted(mining.match_all_items(told, kept, "o_orderkey", carried=("o_orderstatus",)), "o_orderstatus")
    base = told.groupingSets([["answer", "o_orderstatus"], ["answer"], ["o_orderstatus"], []], "answer", "o_orderstatus").agg(
        F.grouping("answer").alias("of_all"), F.count(F.lit(1)).alias("n")
    )
    share = base.filter("of_all = 0").select("answer", F.col("o_orderstatus").alias("d"), "n").alias("s").join(
        base.filter("of_all = 1").select(F.col("o_orderstatus").alias("e"), F.col("n").alias("of")), F.col("d").eqNullSafe(F.col("e"))
    )
    rows = active.join(kept.select("rank", "answer"), "rank").join(share.select(F.col("answer").alias("a"), "d", "n", "of"), (F.col("answer") == F.col("a")) & F.col("group").eqNullSafe(F.col("d")))
    return rows.select("rank", F.col("group").alias("dataset"), "active", "positive", F.round(F.col("positive") / F.col("active") / (F.col("n") / F.col("of")), 6).alias("lift"))


@query(
    _PRUNED
    + """, o AS (SELECT k, answer, list(item) AS items FROM t GROUP BY ALL), xs AS (SELECT rank, answer, list_filter(itemset, lambda i: starts_with(i, 'V_')) AS cues, list_filter(itemset, lambda i: NOT starts_with(i, 'V_')) AS words FROM p),
    hit AS (SELECT xs.rank, xs.answer = o.answer AS correct FROM xs JOIN o ON len(list_filter(xs.words, lambda i: NOT list_contains(o.items, i))) = 0 AND (len(xs.cues) = 0 OR list_has_any(xs.cues, o.items)))
    SELECT rank, count(*) AS active, sum(correct::INT)::BIGINT AS positive FROM hit GROUP BY rank"""
)
def q9_match_keywords_any_cue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in which a pruned rule is active by all its keywords and any of its cues."""
    own, rules = baskets_and_rules(spark, sf_dir)
    hits = mining.match_all_items(own, mining.without_redundant(rules, LONGEST), "o_orderkey", any_cue=True)
    return hits.groupBy("rank").agg(F.count(F.lit(1)).alias("active"), F.sum(F.col("correct").cast("long")).alias("positive"))


_NAMED = """, z AS (SELECT *, list_transform(list_filter(itemset, lambda i: starts_with(i, 'V_')), lambda i: i[3:]) AS cues, list_filter(itemset, lambda i: NOT starts_with(i, 'V_')) AS words FROM m)
    SELECT array_to_string(words, '|') AS text_keywords, array_to_string(cues, '|') AS visual_cues, array_to_string(words, ' ') AS trigger, answer,
      row_number() OVER (ORDER BY confidence DESC, n_items DESC, len(itemset), answer, itemset)::INT AS by_items, row_number() OVER (ORDER BY confidence DESC, n_items DESC, answer || ' ' || array_to_string(itemset, ' '))::INT AS by_name,
      row_number() OVER (ORDER BY confidence DESC, n_items DESC, len(itemset) DESC, itemset, answer)::INT AS by_length, row_number() OVER (ORDER BY n_items DESC, confidence DESC, itemset, answer)::INT AS by_support FROM z WHERE len(cues) > 0"""


@query(_RULES + _NAMED)
def q10_rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules with a cue, their parts by name, and their rank in each of the four orders."""
    rows = mining.rule_rows(mining.with_cue(baskets_and_rules(spark, sf_dir)[1].drop("rank")))
    for name in mining.ORDERS:
        rows = mining.ranked(rows, name).withColumnRenamed("rank", f"by_{name}")
    return rows.select(F.array_join("text_keywords", "|").alias("text_keywords"), F.array_join("visual_cues", "|").alias("visual_cues"), "trigger", "answer", *[f"by_{n}" for n in mining.ORDERS])


@query(_RULES + """, z AS (SELECT * FROM m WHERE confidence >= 0.1 AND len(list_filter(itemset, lambda i: starts_with(i, 'V_'))) > 0) SELECT array_to_string(itemset, '|') AS itemset, answer, row_number() OVER (ORDER BY n_items DESC, confidence DESC, itemset, answer)::INT AS rank FROM z QUALIFY row_number() OVER (ORDER BY n_items DESC, confidence DESC, itemset, answer) <= 20""")
def q14_best_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best rules by support, of those with a cue and enough confidence."""
    rules = mining.with_cue(baskets_and_rules(spark, sf_dir)[1].drop("rank")).filter("confidence >= 0.1")
    return mining.best_rules(rules, 20, "support").select(F.array_join("itemset", "|").alias("itemset"), "answer", "rank")


_SPOKEN = """w AS (SELECT p_partkey, lower(p_name) || chr(39) || 's ' || lower(p_type) || ' ' || p_partkey % 30 AS text FROM part),
    a AS (SELECT answer, row_number() OVER (ORDER BY answer DESC) AS answer_id FROM (SELECT DISTINCT lower(p_name) AS answer FROM part WHERE p_partkey % 2 = 0 UNION SELECT DISTINCT lower(p_type) FROM part UNION SELECT (p_partkey % 30)::VARCHAR FROM part UNION SELECT DISTINCT string_split(lower(p_name), ' ')[2] FROM part UNION SELECT 's ' || lower(p_type) FROM part)),
    x AS (SELECT p_partkey, regexp_extract_all(text, '[a-z0-9]+|' || chr(39)) AS l FROM w), n AS (SELECT unnest(range(1, 3)) AS n),
    g AS (SELECT DISTINCT p_partkey, array_to_string(l[i:i + n - 1], ' ') AS answer FROM (SELECT p_partkey, l, unnest(range(1, len(l) + 1)) AS i FROM x), n WHERE i + n - 1 <= len(l)),
    c AS (SELECT p_partkey, answer FROM g JOIN a USING (answer) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY answer_id) <= 3)"""


def _spoken(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part, low = table(spark, sf_dir, "part"), lambda c: F.lower(c)
    texts = part.select("p_partkey", F.concat(low("p_name"), F.lit("'s "), low("p_type"), F.lit(" "), (F.col("p_partkey") % 30).cast("string")).alias("text"))
    words = [low("p_type"), (F.col("p_partkey") % 30).cast("string"), F.get(F.split(low("p_name"), " "), F.lit(1)), F.concat(F.lit("s "), low("p_type"))]
    answers = part.filter("p_partkey % 2 = 0").select(low("p_name").alias("answer"))
    for w in words:
        answers = answers.unionByName(part.select(w.alias("answer")))
    return texts, corpus.numbered(answers.distinct(), [F.col("answer").desc()], "answer_id", 1)


@query("WITH " + _SPOKEN + " SELECT p_partkey, answer FROM c")
def q11_answer_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known answers within texts, at most three of each: the limit is the feature."""
    texts, answers = _spoken(spark, sf_dir)
    return mining.answer_candidates(texts, "p_partkey", "text", answers, 3)


@query(
    _RULES
    + """, s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderpriority) ELSE 'maybe ' || lower(o_orderpriority) || ' or 2-high' END AS text FROM orders),
    a AS (SELECT answer, lower(regexp_replace(answer, '-', ' ')) AS said, lower(answer) AS plain FROM (SELECT DISTINCT answer FROM r)),
    c AS (SELECT s.o_orderkey, a.answer FROM s JOIN a ON s.text = a.plain OR contains(' ' || array_to_string(regexp_extract_all(s.text, '[a-z0-9]+'), ' ') || ' ', ' ' || a.said || ' ')),
    o AS (SELECT k, list(item) AS items FROM t GROUP BY k)
    SELECT c.o_orderkey, min(r.rank) AS rank FROM c JOIN o ON o.k = c.o_orderkey JOIN r ON r.answer = c.answer AND len(list_filter(r.itemset, lambda i: NOT starts_with(i, 'V_') AND NOT list_contains(o.items, i))) = 0
    WHERE len(list_filter(r.itemset, lambda i: starts_with(i, 'V_') AND list_contains(o.items, i))) > 0 GROUP BY 1"""
)
def q12_match_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rule of each order whose answer is, or stands within, the order's text."""
    own, rules = baskets_and_rules(spark, sf_dir)
    low = F.lower("o_orderpriority")
    texts = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, low).otherwise(F.concat(F.lit("maybe "), low, F.lit(" or 2-high"))).alias("text"))
    answers = corpus.numbered(rules.select(F.col("answer").alias("name")).distinct(), [F.col("name")], "answer_id", 1)
    said = staged(answers.select("answer_id", "name", F.explode(F.array(F.lower("name"), F.lower(F.regexp_replace("name", "-", " ")))).alias("answer")))
    found = mining.answer_candidates(texts, "o_orderkey", "text", said).join(counted(said.select("answer", "name")), "answer").select("o_orderkey", F.col("name").alias("answer")).distinct()
    return mining.match_any_cue(mining.with_candidates(own, found, "o_orderkey"), rules, "o_orderkey")


@query("""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS keyword FROM documents), k AS (SELECT keyword, row_number() OVER (ORDER BY count(*) DESC, keyword) AS id FROM w GROUP BY keyword HAVING count(*) >= 20),
    c AS (SELECT doc_id, keyword, id FROM w JOIN k USING (keyword) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY id) <= 64)
    SELECT doc_id, count(*)::INT AS n, arg_max(keyword, id) AS last FROM c GROUP BY doc_id""")
def q13_lowest_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64 most frequent known words of each document: the limit is the feature."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("items"))
    counts = mining.vocabulary(mining.item_counts(rows), 20)
    known = corpus.numbered(counts, [F.col("n").desc(), F.col("item")], "keyword_id", 1).select(F.col("item").alias("keyword"), "keyword_id")
    found = mining.lowest_keywords(rows, "doc_id", "items", known)
    return found.select("doc_id", F.size("keywords").alias("n"), F.element_at("keywords", -1).alias("last"))
