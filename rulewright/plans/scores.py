"""Evaluation queries: predictions and labels are made of the tables' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.operators import scores as S
from rulewright.plans.catalog import query
from rulewright.sources.tables import table


@query("""WITH r AS (SELECT o_orderpriority, o_orderstatus = 'F' AS label, o_totalprice > 150000 AS said FROM orders),
    c AS (SELECT o_orderpriority, count(*) FILTER (label AND said) AS tp, count(*) FILTER (NOT label AND said) AS fp, count(*) FILTER (NOT label AND NOT said) AS tn, count(*) FILTER (label AND NOT said) AS fn FROM r GROUP BY GROUPING SETS ((o_orderpriority), ()))
    SELECT o_orderpriority, tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 9) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision,
      round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1, round((tp + fp) / (tp + fp + tn + fn), 9) AS yes_ratio FROM c""")
def a1_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary metrics by priority and in all."""
    rows = table(spark, sf_dir, "orders")
    found = S.confusion(rows, F.col("o_orderstatus") == "F", F.col("o_totalprice") > 150000, ["o_orderpriority"])
    rates = ["accuracy", "precision", "recall", "f1", "yes_ratio"]
    return found.select("o_orderpriority", "tp", "fp", "tn", "fn", *[F.round(c, 9).alias(c) for c in rates])


@query("""WITH r AS (SELECT event_id, 'img' || event_id // 4 || CASE event_id % 4 WHEN 0 THEN '.jpg' ELSE '_0' || event_id % 4 || '.png' END AS image, CASE WHEN event_id % 4 = 3 THEN 'b' ELSE 'a' END AS question, event_id % 4 = 0 AS original,
      event_id % 8 < 6 AS removed, CASE WHEN event_id % 4 = 0 THEN 'yes' ELSE 'no' END AS gt, CASE WHEN user_id % 7 = 0 THEN 'maybe' WHEN value > 20 THEN 'yes' ELSE 'no' END AS answer FROM events),
    k AS (SELECT *, CASE WHEN gt = 'yes' AND answer = 'yes' THEN 'TP' WHEN gt = 'no' AND answer <> 'yes' THEN 'TN' WHEN gt = 'yes' THEN 'FN' ELSE 'FP' END AS kind FROM r),
    m AS (SELECT e.kind, e.removed, o.kind AS before FROM k e LEFT JOIN k o ON o.original AND o.image = regexp_replace(e.image, '_[0-9]{2}\\.(png|jpg)$', '.jpg') AND o.question = e.question WHERE NOT e.original),
    s AS (SELECT count(*) FILTER (before IS NOT NULL AND removed) AS removed_pairs, count(*) FILTER (before IS NOT NULL AND NOT removed) AS other_pairs, count(*) FILTER (before IS NULL) AS missing,
      count(*) FILTER (removed AND before || kind = 'TPTN') AS tu, count(*) FILTER (removed AND before || kind = 'FNFP') AS ig, count(*) FILTER (removed AND before || kind = 'TPFP') AS sb_plus, count(*) FILTER (removed AND before || kind = 'FNTN') AS sb_minus,
      count(*) FILTER (NOT removed AND before[1] <> kind[1]) AS changed FROM m),
    c AS (SELECT count(*) FILTER (kind = 'TP') AS tp, count(*) FILTER (kind = 'FP') AS fp, count(*) FILTER (kind = 'TN') AS tn, count(*) FILTER (kind = 'FN') AS fn, count(*) FILTER (answer = 'maybe') AS invalid FROM k),
    x AS (SELECT *, 100 * tu / removed_pairs AS u, 100 - CASE WHEN other_pairs > 0 THEN 100 * changed / other_pairs ELSE 0 END AS v FROM c, s)
    SELECT * EXCLUDE (u, v), round(2 * u * v / (u + v), 9) AS f1_tu_id FROM x""")
def a2_edited_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers on edited images against those on the originals, over images made of events."""
    k = F.col("event_id") % 4
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("img"), F.floor(F.col("event_id") / 4), F.when(k == 0, ".jpg").otherwise(F.concat(F.lit("_0"), k, F.lit(".png")))).alias("image"), F.when(k == 3, "b").otherwise("a").alias("question"),
        (k == 0).alias("original"), (F.col("event_id") % 8 < 6).alias("removed"), F.when(k == 0, "yes").otherwise("no").alias("gt"),
        F.when(F.col("user_id") % 7 == 0, "maybe").when(F.col("value") > 20, "yes").otherwise("no").alias("answer"),
    )
    return S.edited_pairs(rows).withColumn("f1_tu_id", F.round("f1_tu_id", 9))


@query("""WITH m AS (SELECT l_orderkey, least(count(*), 10) AS k FROM lineitem GROUP BY 1)
    SELECT l_orderkey, k::BIGINT AS matches, round((k * least(1, (k - 1) / 3) + (10 - k) * least(1, k / 3)) / 10, 9) AS accuracy FROM m""")
def a3_soft_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft-vote accuracies, with the lines of an order as votes for it."""
    votes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.least(F.count(F.lit(1)), F.lit(10)).cast("long").alias("matches"))
    return votes.withColumn("accuracy", F.round(S.soft_accuracy(F.col("matches")), 9))


@query("""WITH p AS (SELECT p_partkey, lower(trim(p_name)) AS a, lower(trim(p_type)) AS b FROM part), s AS (SELECT *, 1 - levenshtein(a, b) / greatest(length(a), length(b)) AS s FROM p)
    SELECT p_partkey, round(CASE WHEN s >= 0.5 THEN s ELSE 0 END, 9) AS anls FROM s""")
def a4_anls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised edit similarity of each part's name and type."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(S.anls(F.col("p_name"), F.col("p_type")), 9).alias("anls"))


@query("""SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90,
    min(value) AS least, max(value) AS most, round(stddev_pop(value), 6) AS deviation FROM events GROUP BY 1""")
def a5_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the events' values by type."""
    found = S.summary(table(spark, sf_dir, "events"), "value", ["event_type"])
    return found.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p10", "median", "p90")], "least", "most", F.round("deviation", 6).alias("deviation"))


@query("""WITH r AS (SELECT event_id, user_id, (value > 20)::INT::DOUBLE AS reward FROM events), g AS (SELECT user_id, avg(reward) AS m, stddev_pop(reward) AS d FROM r GROUP BY 1)
    SELECT event_id, round(CASE WHEN d < 1e-4 THEN 0 ELSE (reward - m) / (d + 1e-4) END, 6) AS advantage FROM r JOIN g USING (user_id)""")
def a6_advantages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards normalised within each user's events."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("value") > 20).cast("double").alias("reward"))
    return S.advantages(rows, "user_id", "reward").select("event_id", F.round("advantage", 6).alias("advantage"))


@query("""WITH d AS (SELECT l_returnflag, l_discount - l_tax AS d FROM lineitem) SELECT l_returnflag, round(avg(d), 6) AS mean_difference, count(*) FILTER (abs(d) >= 1e-12 AND d > 0) AS above,
    count(*) FILTER (abs(d) >= 1e-12 AND d < 0) AS below, count(*) FILTER (abs(d) < 1e-12) AS equal FROM d GROUP BY 1""")
def a7_paired_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discount against tax, line by line."""
    found = S.compared(table(spark, sf_dir, "lineitem"), "l_discount", "l_tax", ["l_returnflag"])
    return found.withColumn("mean_difference", F.round("mean_difference", 6))


@query("""WITH p AS (SELECT p_brand, p_partkey, p_retailprice AS s, p_type = 'PROMO' OR p_size % 3 = 0 AS hit FROM part), n AS (SELECT p_brand, count(*) FILTER (hit) AS positives FROM p GROUP BY 1 HAVING count(*) FILTER (hit) > 0),
    r AS (SELECT *, row_number() OVER w AS k, count(*) FILTER (hit) OVER w AS tp FROM p WINDOW w AS (PARTITION BY p_brand ORDER BY s DESC, p_partkey)),
    q AS (SELECT p_brand, unnest(range(101)) AS point FROM n),
    b AS (SELECT q.p_brand, point, coalesce(max(tp / k) FILTER (hit AND tp * 100 >= point * positives), 0) AS best FROM q JOIN n USING (p_brand) JOIN r USING (p_brand) GROUP BY 1, 2)
    SELECT p_brand, positives, round(avg(best), 6) AS ap FROM b JOIN n USING (p_brand) GROUP BY 1, 2""")
def a8_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision of each brand's parts ranked by price, at 101 recalls."""
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice", ((F.col("p_type") == "PROMO") | (F.col("p_size") % 3 == 0)).alias("hit"))
    positives = rows.filter("hit").groupBy("p_brand").agg(F.count(F.lit(1)).alias("positives"))
    return S.average_precision(rows, "p_brand", "p_retailprice", "p_partkey", "hit", positives).withColumn("ap", F.round("ap", 6))


@query("""WITH i AS (SELECT user_id, count(*) FILTER (value > 30 AND event_type = 'click') AS tp, count(*) FILTER (value > 90 AND event_type <> 'click') AS fp, count(*) FILTER (value < 2 AND event_type = 'view') AS fn FROM events GROUP BY 1),
    s AS (SELECT sum(tp) FILTER (tp + fn > 0)::DOUBLE AS tp, sum(fp) FILTER (tp + fn > 0)::DOUBLE AS fp, sum(fn) FILTER (tp + fn > 0)::DOUBLE AS fn, count(*) FILTER (tp + fn > 0 AND tp + fp > 0)::DOUBLE AS a,
      count(*) FILTER (tp + fn = 0 AND tp + fp > 0)::DOUBLE AS b, count(*) FILTER (tp + fn > 0 AND tp + fp = 0)::DOUBLE AS c, count(*) FILTER (tp + fn = 0 AND tp + fp = 0)::DOUBLE AS d FROM i),
    m AS (SELECT 2 * tp / (2 * tp + fp + fn + 1e-6) AS f, (a * d - b * c) / (sqrt((a + b) * (a + c)) * sqrt((d + b) * (d + c)) + 1e-6) AS mcc FROM s)
    SELECT round(f, 6) AS positive_f1, round(mcc, 6) AS mcc, round(f * mcc, 6) AS cg_f1 FROM m""")
def a9_gated_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification-gated F1 over users as images."""
    n = lambda c: F.count(F.when(F.expr(c), 1))
    images = table(spark, sf_dir, "events").groupBy("user_id").agg(n("value > 30 and event_type = 'click'").alias("tp"), n("value > 90 and event_type <> 'click'").alias("fp"), n("value < 2 and event_type = 'view'").alias("fn"))
    found = S.cg_f1(images)
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query("""SELECT event_type, user_id % 3 = 0 AS third, count(*) AS n, count(*) FILTER (value > 20) AS above FROM events GROUP BY GROUPING SETS ((event_type, user_id % 3 = 0), (event_type), ())""")
def a10_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-key counts with the totals of the first key and of all."""
    rows = table(spark, sf_dir, "events").withColumn("third", F.col("user_id") % 3 == 0)
    counts = [F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("value") > 20, 1)).alias("above")]
    return rows.groupingSets([["event_type", "third"], ["event_type"], []], "event_type", "third").agg(*counts)


@query("""WITH p AS (SELECT p_partkey AS k, p_brand AS grp, string_split(lower(p_name || ' ' || p_type), ' ') AS w, string_split(lower(p_type), ' ') AS t, string_split(lower(p_name), ' ') AS m FROM part),
    d AS (SELECT k, grp, CASE WHEN k % 4 = 0 THEN w[2:] WHEN k % 4 = 1 THEN w || w[:2] WHEN k % 4 = 2 THEN list_reverse(w) ELSE m END AS f, [w, t || m] AS ts FROM p),
    fg AS (SELECT k, grp, n, array_to_string(f[i:i + n - 1], ' ') AS g FROM (SELECT k, grp, f, n, unnest(range(1, len(f) - n + 2)) AS i FROM d, (SELECT unnest([1, 2, 3, 4]) AS n) x)),
    tg AS (SELECT k, j, n, array_to_string(t[i:i + n - 1], ' ') AS g FROM (SELECT k, j, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM (SELECT k, unnest(ts) AS t, unnest([0, 1]) AS j FROM d), (SELECT unnest([1, 2, 3, 4]) AS n) x)),
    fc AS (SELECT k, grp, n, g, count(*) AS c FROM fg GROUP BY ALL), tc AS (SELECT k, n, g, max(c) AS m FROM (SELECT k, j, n, g, count(*) AS c FROM tg GROUP BY ALL) GROUP BY ALL),
    c AS (SELECT grp, n, sum(least(c, coalesce(m, 0))) AS r, sum(c) AS a FROM fc LEFT JOIN tc USING (k, n, g) GROUP BY ALL),
    z AS (SELECT grp, sum(len(f)) AS size, sum(list_min([[abs(len(t) - len(f)), len(t)] for t in ts])[2]) AS wanted FROM d GROUP BY 1),
    q AS (SELECT grp, coalesce(max(r) FILTER (n = 1), 0) AS r1, coalesce(max(r) FILTER (n = 2), 0) AS r2, coalesce(max(r) FILTER (n = 3), 0) AS r3, coalesce(max(r) FILTER (n = 4), 0) AS r4, coalesce(max(a) FILTER (n = 1), 0) AS a1, coalesce(max(a) FILTER (n = 2), 0) AS a2, coalesce(max(a) FILTER (n = 3), 0) AS a3, coalesce(max(a) FILTER (n = 4), 0) AS a4 FROM c GROUP BY 1),
    b AS (SELECT grp, CASE WHEN size < wanted THEN exp(1 - (wanted + 1e-9) / (size + 1e-15)) ELSE 1 END AS s, (r1 + 1e-15) / (a1 + 1e-9) AS p1, (r2 + 1e-15) / (a2 + 1e-9) AS p2, (r3 + 1e-15) / (a3 + 1e-9) AS p3, (r4 + 1e-15) / (a4 + 1e-9) AS p4 FROM q JOIN z USING (grp))
    SELECT grp, round(s * p1, 6) AS bleu_1, round(s * sqrt(p1 * p2), 6) AS bleu_2, round(s * pow(p1 * p2 * p3, 1.0 / 3), 6) AS bleu_3, round(s * pow(p1 * p2 * p3 * p4, 0.25), 6) AS bleu_4 FROM b""")
def a11_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of changed names of parts against two forms of them, by brand."""
    words = lambda *c: F.split(F.lower(F.concat_ws(" ", *c)), " ")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("grp"), words("p_name", "p_type").alias("w"), words("p_type").alias("t"), words("p_name").alias("m"))
    k, w = F.col("p_partkey") % 4, F.col("w")
    found = F.when(k == 0, F.slice(w, F.lit(2), F.size(w))).when(k == 1, F.concat(w, F.slice(w, 1, 2))).when(k == 2, F.reverse(w)).otherwise(F.col("m"))
    scored = S.bleu(rows.select("p_partkey", "grp", found.alias("found"), F.array("w", F.concat("t", "m")).alias("truths")), "p_partkey", by=["grp"])
    return scored.select("grp", *[F.round(f"bleu_{n}", 6).alias(f"bleu_{n}") for n in range(1, 5)])
