"""Streams over several files, stopped and resumed."""

import json
import random

import pandas as pd
import pytest

from rulewright.streaming import events

SCHEMA = "key long, item string, bits array<int>, needed long, number int"


def rows_of_files():
    """Five files of items, out of order, with repeated and late ones, and what each key's union is."""
    rng = random.Random(4)
    needed = {k: rng.randint(1, 4) for k in range(30)}
    rows = [(k, f"cue{i}", [int(rng.random() < 0.3) for _ in range(16)] if rng.random() < 0.9 else None, needed[k] if rng.random() < 0.8 else None) for k in needed for i in range(needed[k])]
    rows += rng.choices(rows, k=40)
    rng.shuffle(rows)
    rows = [(k, i, b, needed[k] if n is None and rng.random() < 0.5 else n) for k, i, b, n in rows]
    return [[(*r, f) for r in rows[f::5]] for f in range(5)]


def expected(files):
    """The keys that are complete after some files, with their items and unions."""
    seen, unions, needs, done = {}, {}, {}, {}
    for k, item, bits, need, _ in (r for f in files for r in f):
        needs[k] = need if need is not None else needs.get(k)
        if k not in done:
            if item not in seen.setdefault(k, set()):
                seen[k].add(item)
                unions[k] = [x | y for x, y in zip(unions.get(k) or [0] * 16, bits or [0] * 16, strict=True)]
            if needs[k] is not None and len(seen[k]) >= needs[k]:
                done[k] = (len(seen[k]), unions[k])
    return done


def same(got, want):
    assert len(got) == len({r.key for r in got}) and {r.key for r in got} == set(want)
    for r in got:
        # a key without any mask has an empty union
        assert (r["items"], (r.bits + [0] * 16)[:16]) == want[r.key]


def test_completed_unions_stop_and_resume(spark, tmp_path):
    files, base, where = rows_of_files(), str(tmp_path / "state"), str(tmp_path / "in")
    for some in (2, 4, 5):
        for rows in files[(0 if some == 2 else some - (2 if some == 4 else 1)) : some]:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(where)
        same(events.completed_unions(spark, where, base).collect(), expected(files[:some]))
    # nothing new: nothing is written twice
    same(events.completed_unions(spark, where, base).collect(), expected(files))


def test_a_broken_run_is_taken_up_again(spark, tmp_path):
    files, base, where = rows_of_files(), str(tmp_path / "state"), str(tmp_path / "in")
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(where)
    with events.keyed_state(spark):
        stream = events.completions(events.stream_of(spark, where)).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(processingTime="0 seconds").start()
        while stream.lastProgress is None or stream.lastProgress["batchId"] < 1:
            assert stream.exception() is None
        stream.stop()
    same(events.completed_unions(spark, where, base).collect(), expected(files))


def test_shards_after_a_marker(spark, tmp_path):
    for name, n in (("a", 3), ("b", 2)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.json").write_text("\n".join(json.dumps({"i": i}) for i in range(n)) + "\n\n")
    with pytest.raises(TimeoutError):
        events.after_marker(spark, str(tmp_path), "_DONE", {"a": 3, "b": 2})
    (tmp_path / "_DONE").touch()
    assert events.after_marker(spark, str(tmp_path), "_DONE", {"a": 3, "b": 2}).count() == 5
    with pytest.raises(ValueError, match="shard b has 2 lines, not 4"):
        events.after_marker(spark, str(tmp_path), "_DONE", {"a": 3, "b": 4})


def test_a_key_is_one_call_of_the_state():
    class Value:
        """A state that counts its calls."""

        calls, value = 0, None

        def get(self):
            Value.calls += 1
            return self.value

        def update(self, value):
            Value.calls += 1
            self.value = value

    processor = events._Completion()
    processor.init(type("Handle", (), {"getValueState": lambda *_: Value(), "getMapState": lambda *_: None})())
    batch = lambda *items: pd.DataFrame({"item": list(items), "bits": [[0, 1]] * len(items), "needed": [4] * len(items), "number": [7] * len(items)})
    assert not list(processor.handleInputRows((1,), iter([batch("a", "b"), batch("a")]), None)) and Value.calls == 2
    (came,) = processor.handleInputRows((1,), iter([batch("c", "b", "d", "e")]), None)
    assert came.iloc[0].to_dict() == {"key": 1, "items": 4, "bits": [0, 1], "batch": 7} and Value.calls == 4
    assert not list(processor.handleInputRows((1,), iter([batch("f")]), None))
