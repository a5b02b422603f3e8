"""Queries that write a table in one of the file forms and read it again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.functions import text as T
from rulewright.operators import scores as S
from rulewright.plans.catalog import query
from rulewright.plans.texts import QUESTIONS_SQL, questions
from rulewright.sources import records as R
from rulewright.sources.staging import run_dir
from rulewright.sources.tables import table

_SCHEMA = "question_id long, image_id long, question string, answer string"
_PLAIN = f"WITH {QUESTIONS_SQL} SELECT question_id, image_id, question, answer FROM q"


def _path(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("question_id", "image_id", "question", "answer")


@query(_PLAIN)
def x1_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines, written and read strictly."""
    path = _path(spark, "lines")
    R.write_lines(_plain(spark, sf_dir), path)
    return R.json_lines(spark, [path, path], _SCHEMA, strict=True)


@query(_PLAIN)
def x2_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON array, written and read with detection of its form."""
    path = _path(spark, "array")
    R.write_array(_plain(spark, sf_dir), path, [F.col("question_id")])
    return R.json_any(spark, path, _SCHEMA)


@query(f"WITH {QUESTIONS_SQL} SELECT row_number() OVER (ORDER BY question_id::VARCHAR) - 1 AS ord, question_id::VARCHAR AS question_id, image_id::VARCHAR AS image_id, question, answer FROM q")
def x3_keyed_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON object by id, read in the order of the ids' texts."""
    path = _path(spark, "object")
    R.write_array(_plain(spark, sf_dir).withColumn("imageId", F.col("image_id").cast("string")).drop("image_id"), path, [F.col("question_id")], "question_id")
    return R.keyed_answers(spark, path)


@query(f"WITH {QUESTIONS_SQL} SELECT row_number() OVER (ORDER BY question_id) - 1 AS ord, question_id, image_id, question, answer FROM q")
def x20_ordered_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON array with the places of its records, read in splits."""
    path = _path(spark, "array")
    R.write_array(_plain(spark, sf_dir), path, [F.col("question_id")])
    return R.json_document(spark, path, _SCHEMA)


@query("SELECT count(*) AS rows, count(*) FILTER (c_acctbal > 0) AS positive, count(*) FILTER (c_mktsegment = 'BUILDING') AS building FROM customer")
def x21_counts_beside_a_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that are taken while rows are written, read from beside them."""
    path = _path(spark, "counted")
    R.write_with_counts(table(spark, sf_dir, "customer"), path, {"positive": F.col("c_acctbal") > 0, "building": F.col("c_mktsegment") == "BUILDING"})
    return spark.read.schema("rows long, positive long, building long").json(f"{path}/counts")


@query(f"WITH {QUESTIONS_SQL} SELECT row_number() OVER (ORDER BY question_id) - 1 AS ord, question_id, question FROM q")
def x4_wrapped_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list under a key of one object."""
    path = _path(spark, "wrapped")
    rows = _plain(spark, sf_dir).select("question_id", "question")
    whole = rows.agg(F.array_sort(F.collect_list(F.struct("question_id", "question"))).alias("questions"))
    whole.write.json(path)
    return R.json_document(spark, path, "question_id long, question string", "questions")


@query("""WITH l AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{bad' WHEN 1 THEN '' ELSE props END AS v, row_number() OVER (ORDER BY event_id) AS n FROM events)
    SELECT count(*) FILTER (v <> '' AND NOT json_valid(v)) AS bad, min(n) FILTER (v <> '' AND NOT json_valid(v)) AS first_bad FROM l""")
def x5_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are no JSON, and the number of the first."""
    path, e = _path(spark, "bad"), F.col("event_id")
    lines = table(spark, sf_dir, "events").select("event_id", F.when(e % 5 == 0, "{bad").when(e % 5 == 1, "").otherwise(F.col("props")).alias("value"))
    lines.repartition(1).sortWithinPartitions("event_id").select("value").write.text(path)
    return R.bad_lines(spark, path).select("bad", "first_bad")


@query(f"WITH {QUESTIONS_SQL} SELECT question_id, image_id, answer_type, replace(answer, chr(10), ' ') AS answer FROM q")
def x6_tab_separated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab-separated values; empty fields are null."""
    path = _path(spark, "tabs")
    rows = questions(spark, sf_dir).select("question_id", "image_id", "answer_type", F.translate("answer", "\n", " ").alias("answer"))
    rows.write.option("sep", "\t").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", '""').csv(path)
    read = R.tab_separated(spark, path, "question_id long, image_id long, answer_type string, answer string")
    return read.withColumn("answer", F.coalesce("answer", F.lit("")))


@query("""WITH p AS (SELECT p_partkey, p_partkey % 10 AS parent, 'Is ' || p_name AS question, p_type AS answer FROM part) SELECT p_partkey AS question_id, CASE WHEN p_partkey % 3 = 0 THEN p_partkey ELSE parent END AS image_id, question, answer FROM p""")
def x7_nested_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions below their image, and some by themselves."""
    path, k = _path(spark, "nested"), F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k, (k % 10).alias("parent"), F.concat(F.lit("Is "), F.col("p_name")).alias("question"), F.col("p_type").alias("answer"))
    below = rows.filter(k % 3 != 0).groupBy(F.col("parent").alias("id")).agg(F.collect_list(F.struct(k.alias("qa_id"), "question", "answer")).alias("qas"))
    alone = rows.filter(k % 3 == 0).select(k.alias("question_id"), k.alias("image_id"), "question", "answer")
    below.write.json(f"{path}/a")
    alone.write.json(f"{path}/b")
    return R.nested_answers(spark, [f"{path}/a", f"{path}/b"])


@query("""SELECT p_partkey // 20 AS image_id, 'img' || p_partkey // 20 AS file_name, p_partkey AS id, p_type AS category, (p_partkey % 50)::DOUBLE AS x0, (p_partkey % 50 + p_size)::DOUBLE AS x1, p_size * 2.0::DOUBLE AS area, p_partkey % 9 = 0 AS crowd FROM part WHERE p_partkey // 20 % 3 > 0""")
def x8_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes, areas and crowds of an annotation file, for a part of its images."""
    path, k = _path(spark, "notes"), F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    kinds = part.select("p_type").distinct().select(F.crc32("p_type").alias("id"), F.col("p_type").alias("name"))
    lists = lambda rows, name: rows.agg(F.collect_list(F.struct(*rows.columns)).alias(name))
    images = part.select(F.floor(k / 20).alias("id")).distinct().select("id", F.concat(F.lit("img"), F.col("id").cast("string")).alias("file_name"))
    notes = part.select(k.alias("id"), F.floor(k / 20).alias("image_id"), F.crc32("p_type").alias("category_id"), F.array((k % 50).cast("double"), F.lit(1.0), F.col("p_size").cast("double"), F.lit(2.0)).alias("bbox"), (F.col("p_size") * 2.0).alias("area"), (k % 9 == 0).cast("int").alias("iscrowd"))
    lists(images, "images").crossJoin(lists(kinds, "categories")).crossJoin(lists(notes, "annotations")).coalesce(1).write.json(path)
    rows = R.annotations_of(spark, path, images.filter("id % 3 > 0").select(F.col("id").alias("image_id")))
    return rows.select("image_id", "file_name", "id", "category", F.get("box", F.lit(0)).alias("x0"), F.get("box", F.lit(2)).alias("x1"), "area", "crowd")


@query("SELECT c_mktsegment AS split, c_nationkey, count(*) AS n FROM customer GROUP BY ALL")
def x9_splits_and_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of splits, and a summary written beside the rows."""
    path = _path(spark, "splits")
    R.write_splits(table(spark, sf_dir, "customer").withColumn("split", F.col("c_mktsegment")), path)
    R.write_with_summary(spark.read.parquet(path), f"{path}-all", ["split", "c_nationkey"])
    return spark.read.schema("split string, c_nationkey int, n long").json(f"{path}-all/summary")


@query("""SELECT p_partkey, replace(p_name, ' ', chr(92) || '|') || '|' || p_type AS names, p_size FROM part""")
def x10_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma-separated values with arrays joined by bars."""
    path = _path(spark, "csv")
    R.write_table(table(spark, sf_dir, "part").select("p_partkey", F.array(F.translate("p_name", " ", "|"), F.col("p_type")).alias("names"), "p_size"), path)
    return spark.read.option("header", True).schema("p_partkey long, names string, p_size int").csv(path)


@query(f"""WITH {QUESTIONS_SQL} SELECT question_id, image_id, lower(trim(question)) AS question_text, CASE WHEN question_id % 4 = 0 THEN '' WHEN question_id % 4 = 1 THEN '' ELSE lower(trim(answer)) END AS answer FROM q""")
def x11_first_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the first annotator's answer."""
    q, k = questions(spark, sf_dir), F.col("question_id")
    answers = F.when(k % 4 == 1, F.array().cast("array<struct<answer_id:int,answer:string>>")).otherwise(F.array(F.struct(F.lit(1).alias("answer_id"), F.col("answer")), F.struct(F.lit(2).alias("answer_id"), F.lit("x").alias("answer"))))
    return R.first_answers(q, q.filter(k % 4 != 0).select("question_id", answers.alias("answers")))


@query("""WITH r AS (SELECT s_suppkey::VARCHAR AS rule_id, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_nationkey / 25 END AS c, s_acctbal AS s, lower(s_name) AS answer FROM supplier)
    SELECT rule_id, 'ab' AS words, answer, row_number() OVER (ORDER BY coalesce(c, 0) DESC, s DESC, rule_id)::INT AS rank FROM r""")
def x12_plain_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules in plain words, ranked."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.cast("string").alias("rule_id"), F.array(F.lit(" AB "), F.lit("")).alias("text_keywords"), F.array().cast("array<string>").alias("visual_cues"), F.concat(F.lit(" "), F.col("s_name")).alias("answer"), F.when(k % 4 > 0, F.col("s_nationkey") / 25).alias("confidence"), F.col("s_acctbal").alias("support"))
    return R.plain_rules(rows).select("rule_id", F.array_join("text_keywords", "|").alias("words"), "answer", "rank")


@query("""WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN event_id % 6 = 0 THEN NULL ELSE value / 40 END AS s FROM events)
    SELECT user_id AS image_id, coalesce(string_agg(upper(event_type), '|' ORDER BY event_id) FILTER (s IS NULL OR s >= 0.3), '') AS legacy, coalesce(string_agg(event_type, '|' ORDER BY event_id) FILTER (coalesce(s, 1) >= 0.5), '') AS joined FROM e GROUP BY 1""")
def x13_plain_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected classes with a sufficient or no score, by two thresholds."""
    from rulewright.operators.images import with_detections

    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.when(F.col("event_id") % 6 > 0, F.col("value") / 40).alias("s"))
    rows = e.groupBy(F.col("user_id").alias("image_id")).agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type", "s"))).alias("x"))
    rows = rows.select("image_id", F.transform("x", lambda x: x["event_type"]).alias("classes"), F.transform("x", lambda x: x["s"]).alias("scores"))
    legacy = R.plain_detections(rows).select("image_id", F.upper(F.array_join("classes", "|")).alias("legacy"))
    joined = with_detections(rows.select("image_id"), rows, 0.5).select("image_id", F.array_join("classes", "|").alias("joined"))
    return legacy.join(joined, "image_id")


@query("""SELECT s_suppkey % 4 AS shard, count(*) AS expected, count(*) - count(*) FILTER (s_suppkey % 8 = 1) AS found FROM supplier WHERE s_suppkey % 4 = 1 GROUP BY 1""")
def x14_shard_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards with fewer lines than they should have."""
    path, rows, k = _path(spark, "shards"), table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    for i in range(4):
        rows.filter((k % 4 == i) & (k % 8 != 1)).select("s_name").write.json(f"{path}/{i}")
    expected = {str(r[0]): r[1] for r in rows.groupBy(k % 4).count().collect()}
    return R.shard_problems(spark, {str(i): f"{path}/{i}" for i in range(4)}, expected).select(F.col("shard").cast("long").alias("shard"), "expected", "found")


@query("""SELECT 'shard-' || s_suppkey % 3 || '.json' AS name FROM supplier GROUP BY 1""")
def x15_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a folder with a suffix."""
    path = _path(spark, "files")
    for i in range(3):
        R.write_lines(table(spark, sf_dir, "region"), f"{path}/shard-{i}")
    found = R.listing(spark, path, [".JSON"])
    return found.select(F.concat(F.element_at(F.split("path", "/"), -2), F.lit(".json")).alias("name")).distinct()


@query("""WITH p AS (SELECT event_id AS ord, CASE WHEN event_id % 3 = 0 THEN 'No, it is' WHEN event_id % 3 = 1 THEN 'yes. not' ELSE 'Nothing' END AS text, CASE event_id % 4 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' WHEN 2 THEN 'no' ELSE 'maybe' END AS label FROM events),
    a AS (SELECT ord % 3 <> 0 AS said, label <> 'no' AS truth FROM p), x AS (SELECT count(*) FILTER (said AND truth) AS tp, count(*) FILTER (said AND NOT truth) AS fp, count(*) FILTER (NOT said AND NOT truth) AS tn, count(*) FILTER (NOT said AND truth) AS fn, 0 AS u FROM a),
    b AS (SELECT label, lower(text) AS t FROM p), y AS (SELECT count(*) FILTER (label = 'yes' AND contains(t, 'yes')) AS tp, count(*) FILTER (label = 'no' AND NOT contains(t, 'no')) AS fp, count(*) FILTER (label = 'no' AND contains(t, 'no')) AS tn, count(*) FILTER (label = 'yes' AND NOT contains(t, 'yes')) AS fn, count(*) FILTER (label = 'maybe') AS u FROM b),
    z AS (SELECT 'positional' AS rule, * FROM x UNION ALL SELECT 'contained', * FROM y)
    SELECT rule, tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn + u), 9) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 9) AS f1, round((tp + fp) / (tp + fp + tn + fn + u), 9) AS yes_ratio FROM z""")
def x16_yes_no_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of yes and no by place, and by what answers contain."""
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(e.alias("ord"), F.when(e % 3 == 0, "No, it is").when(e % 3 == 1, "yes. not").otherwise("Nothing").alias("text"), F.when(e % 4 == 1, "yes").when(e % 4 == 3, "maybe").otherwise("no").alias("label"))
    parts = S.positional_scores(rows.select("ord", "label"), rows).withColumn("rule", F.lit("positional")).unionByName(S.contained_scores(rows).drop("unknown").withColumn("rule", F.lit("contained")))
    return parts.select("rule", "tp", "fp", "tn", "fn", *[F.round(c, 9).alias(c) for c in ("accuracy", "f1", "yes_ratio")])


@query("""WITH p AS (SELECT p_partkey, p_partkey % 7 AS image_id, p_name FROM part), q AS (SELECT DISTINCT image_id, 'Is ' || p_name || ' red?' AS question FROM p WHERE p_partkey % 2 = 0)
    SELECT p_partkey, (image_id, lower('is ' || p_name || ' red?')) IN (SELECT (image_id, lower(question)) FROM q) AS found FROM p""")
def x17_question_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions matched with questions by image and the question in their prompt."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k, (k % 7).alias("image_id"), "p_name")
    known = rows.filter(k % 2 == 0).select("image_id", F.concat(F.lit("Is "), F.col("p_name"), F.lit(" red?")).alias("question")).distinct()
    asked = rows.select(k, "image_id", F.concat(F.lit("OCR tokens: a. Question: Is "), F.col("p_name"), F.lit(" red? Short answer:")).alias("prompt"))
    good, bad = S.question_key_matches(asked, known)
    return good.select("p_partkey", F.lit(True).alias("found")).unionByName(bad.select("p_partkey", F.lit(False).alias("found")))


@query("""WITH w AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders), p AS (SELECT place, 'a' AS text FROM w WHERE place % 3 = 0 UNION ALL SELECT place, 'b' FROM w WHERE place % 3 = 1 UNION ALL SELECT place, 'c' FROM w WHERE place % 6 = 1),
    n AS (SELECT place, count(*) AS n, min(text) AS text FROM p GROUP BY 1) SELECT place, text, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' END AS problem FROM w LEFT JOIN n USING (place)""")
def x18_merged_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of three shards by their source's place or key."""
    from rulewright.operators import corpus as K
    from rulewright.operators import packages as P

    rows = K.numbered(table(spark, sf_dir, "orders").select("o_orderkey"), [F.col("o_orderkey")], "place")
    pick = lambda c, text, by_place: rows.filter(c).select(F.when(F.lit(by_place), F.col("place")).alias("place"), "o_orderkey", F.lit(text).alias("text"))
    merged, problems = P.merged_shards([pick("place % 3 = 0", "a", True), pick("place % 3 = 1", "b", False), pick("place % 6 = 1", "c", True)], rows, "o_orderkey", "place")
    return merged.select("place", "text").join(problems, "place", "left")


@query("""WITH g AS (SELECT vec_id, vec_id // 8 AS q, vec_id % 3 AS cue, unnest(range(64)) AS i, unnest([(x::DOUBLE >= 0.05)::INT for x in embedding]) AS b FROM embeddings WHERE len(embedding) = 64),
    f AS (SELECT * FROM g WHERE vec_id IN (SELECT min(vec_id) FROM g GROUP BY q, cue)), u AS (SELECT q, i, max(b) AS b FROM f GROUP BY ALL), n AS (SELECT q, count(DISTINCT cue) AS n FROM f GROUP BY q)
    SELECT q, round(avg(b), 9) AS ratio, any_value(n.n >= 2 + q % 2) AS finished FROM u JOIN n USING (q) GROUP BY q""")
def x19_finished_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unions of the masks of each question's cues, and whether all have come."""
    from rulewright.operators.images import finished_unions
    from rulewright.plans.geometry import grids

    masks = grids(spark, sf_dir).select("vec_id", F.floor(F.col("vec_id") / 8).alias("q"), (F.col("vec_id") % 3).alias("cue"), "bits")
    masks = masks.groupBy("q", "cue").agg(F.min_by("bits", "vec_id").alias("bits"))
    wanted = masks.select("q").distinct().select("q", F.sequence(F.lit(1), 2 + F.col("q") % 2).alias("cues"))
    return finished_unions(masks, wanted, "q", "bits").select("q", F.round("ratio", 9).alias("ratio"), "finished")


@query(f"""WITH {QUESTIONS_SQL} SELECT question_id, coalesce(nullif(trim(answer), ''), '-') AS answer FROM q""")
def x20_first_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers, or a mark where there is none."""
    return questions(spark, sf_dir).select("question_id", T.first_filled(F.col("answer"), F.lit("-")).alias("answer"))
