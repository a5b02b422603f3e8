"""JSON files read in splits, counts beside a write."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rulewright.sources import jsonvalues, records

PIECES = ["a", "{", "}", "[", "]", '"', "\\", '\\"', ",", ":", "é", "\n", "\U0001f600", " "]


def odd(rng):
    return "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12)))


def objects(n, seed=1):
    rng = random.Random(seed)
    return [{"id": i, "s": odd(rng), odd(rng): [{"x": odd(rng)}, {}, [1, {"y": None}]], "n": {"m": {"k": odd(rng)}}} for i in range(n)]


@pytest.fixture
def splits(spark):
    """Splits of 700 bytes, so that borders fall into strings and escapes."""
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("indent", [None, 1])
def test_json_files_in_splits(spark, tmp_path, splits, indent):
    rows, rng = objects(90), random.Random(2)

    def write(name, value):
        (tmp_path / name).write_text(json.dumps(value, indent=indent, ensure_ascii=bool(indent)))
        return str(tmp_path / name)

    a = write("a.json", rows)
    assert jsonvalues._pieces(spark, a).select("block").distinct().count() > 8
    got = sorted(jsonvalues.json_objects(spark, a).collect(), key=lambda r: r.ord)
    assert [json.loads(r.value) for r in got] == rows and [r.ord for r in got] == list(range(90))
    members = {odd(rng) + str(i): x for i, x in enumerate(rows)}
    got = sorted(jsonvalues.json_members(spark, write("b.json", {"n": 5, **members, "l": [{"x": 1}]})).collect(), key=lambda r: r.ord)
    assert {r.name: json.loads(r.value) for r in got} == members
    whole = {"info": {"v": {"x": {"a": 1}}, "y": {"b": 2}, "l": [{"z": 1}]}, "n": 5, "t": "}]{", "images": rows[:40], "empty": [], "nums": [1, 2], "notes": rows[40:], "last": {"e": {"f": {}}}}
    got = sorted(jsonvalues.json_lists(spark, write("c.json", whole)).collect(), key=lambda r: (r.name, r.ord))
    assert {r.name for r in got} == {"images", "notes"}
    for name in ("images", "notes"):
        assert [(r.ord, json.loads(r.value)) for r in got if r.name == name] == list(enumerate(whole[name]))


def test_small_json_files(spark, tmp_path):
    row = objects(1)[0]
    texts = {"none": "", "empty": "[]", "one": json.dumps(row) + "\n", "lines": "\n".join(map(json.dumps, objects(5))), "two": f" [ {json.dumps(row)} , {json.dumps(row)} ] "}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    read = lambda name: [json.loads(r.value) for r in sorted(jsonvalues.json_objects(spark, str(tmp_path / name)).collect(), key=lambda r: r.ord)]
    assert [read(n) for n in texts] == [[], [], [row], objects(5), [row, row]]
    both = jsonvalues.json_objects(spark, [str(tmp_path / "two"), str(tmp_path / "one")]).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.ord) for r in both) == [("one", 0), ("two", 0), ("two", 1)]


def test_places_of_records(spark, tmp_path):
    rows = [{"a": i, "b": "x"} for i in range(20)]
    (tmp_path / "list.json").write_text(json.dumps(rows))
    (tmp_path / "keyed.json").write_text(json.dumps({"other": rows[:3], "rows": rows}))
    for got in (records.json_document(spark, str(tmp_path / "list.json"), "a long, b string"), records.json_document(spark, str(tmp_path / "keyed.json"), "a long, b string", "rows")):
        assert got.columns == ["ord", "a", "b"] and sorted(map(tuple, got.collect())) == [(i, i, "x") for i in range(20)]


def test_counts_beside_a_write(spark, tmp_path):
    rows = spark.range(100).repartition(5)
    assert records.write_with_counts(rows, str(tmp_path), {"even": F.col("id") % 2 == 0, "none": F.col("id") < 0}) == {"rows": 100, "even": 50, "none": 0}
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 100 and spark.read.json(f"{tmp_path}/counts").first().even == 50
    assert records.write_with_counts(rows.filter("false"), str(tmp_path), {"even": F.col("id") % 2 == 0}) == {"rows": 0, "even": 0}
