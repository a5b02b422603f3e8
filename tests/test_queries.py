"""Every query with SQL against DuckDB, and the entry points without the optional parts."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from rulewright.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rounded(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, duck, sf_dir):
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    rows = rounded(map(tuple, got.select(*columns).collect()))
    if name in ORACLES:
        quoted = ", ".join(f'"{c}"' for c in columns)
        assert rows == rounded(duck.execute(f"SELECT {quoted} FROM ({ORACLES[name]})").fetchall())


def test_entry_point(spark):
    assert entry.entry(spark).columns == ["itemset", "answer", "n_items", "n_both", "confidence", "rank"]
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry_point_without_the_optional_parts(tmp_path):
    root = Path(entry.__file__).parent
    (tmp_path / "rulewright").mkdir()
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    for p in (root / "rulewright").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "rulewright" / p.name).symlink_to(p)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0 and int(done.stdout) == len(QUERIES), done.stderr
