from __future__ import annotations

import time

from weftline import models
from weftline.operators.buckets import BucketStore


class Noted:
    """A call that leaves a line for its start and its end in a file."""

    def __init__(self, path, seconds=0.0):
        self.path, self.seconds = str(path), seconds

    def __call__(self, text):
        self._note(f"{time.time()} 1 {text}")
        time.sleep(self.seconds)
        try:
            if "bad" in text:
                raise ValueError("cannot read this")
            return text.upper()
        finally:
            self._note(f"{time.time()} -1 {text}")

    def _note(self, line):
        with open(self.path, "a") as f:
            f.write(line + "\n")


def events(path):
    return sorted((float(t), int(d), text) for t, d, text in (line.split(" ", 2) for line in open(path).read().splitlines()))


def test_calls_in_flight_and_a_second(spark, tmp_path):
    call = Noted(tmp_path / "log", 0.05)
    rows = spark.createDataFrame([(f"k{i}", f"text {i}") for i in range(24)], "k string, v string")
    out = models.in_lanes(rows, ["k"], "v", call, models.Limits(in_flight=2, per_second=12.0)).collect()
    assert {r["k"]: r["response"] for r in out} == {f"k{i}": f"TEXT {i}" for i in range(24)} and not any(r["error"] for r in out)
    seen = events(tmp_path / "log")
    now = most = 0
    for _, d, _ in seen:
        now += d
        most = max(most, now)
    starts = [t for t, d, _ in seen if d == 1]
    # Two tasks at a time, each with six calls a second: twelve calls of one take eleven waits.
    assert most <= 2 and len(starts) == 24 and starts[-1] - starts[0] >= 11 / 6 - 0.2


def test_failures_are_rows_and_responses_stay(spark, tmp_path):
    call = Noted(tmp_path / "log")
    store = BucketStore(spark, str(tmp_path / "answers"), "k string, response string", ("k",), buckets=2)
    rows = spark.createDataFrame([(f"k{i}", "bad text" if i == 3 else f"text {i}") for i in range(10)] + [("k1", "text 1")], "k string, v string")
    limits = models.Limits(in_flight=2, attempts=2, wait=0.0, wave=4)
    failed = models.ask(rows, "k", "v", call, store, limits).collect()
    assert [(r["k"], r["error"]) for r in failed] == [("k3", "ValueError: cannot read this")]
    assert sorted(r["k"] for r in store.read().collect()) == [f"k{i}" for i in range(10) if i != 3]
    assert sum(1 for _, d, text in events(tmp_path / "log") if d == 1) == 9 + 2  # the bad one twice
    # Run again: only the one that has no response is asked for.
    (tmp_path / "log").write_text("")
    assert models.ask(rows, "k", "v", call, store, limits).count() == 1
    assert {text for _, _, text in events(tmp_path / "log")} == {"bad text"}
    assert models.ask(rows.filter("k <> 'k3'"), "k", "v", call, store, limits).count() == 0


def test_an_insert_keeps_what_was_answered(spark, tmp_path):
    import pytest

    from weftline.engine import Engine, Options

    class Picky(models.RuleModel):
        def extract(self, text):
            with open(tmp_path / "calls", "a") as f:
                f.write("x")
            if "poison" in text and not (tmp_path / "cured").exists():
                raise OSError("busy")
            return super().extract(text)

    e = Engine(spark, str(tmp_path / "kb"), Options(chunk_tokens=4, chunk_overlap=0, buckets=2, limits=models.Limits(in_flight=2, attempts=1)), model=Picky())
    docs = spark.createDataFrame([("Ann met Bea today. Cid met poison Dan. Eve met Fay today.", "a.md")], "content string, file_path string")
    with pytest.raises(RuntimeError, match="no response for 1 chunks"):
        e.insert_documents(docs)
    assert len((tmp_path / "calls").read_text()) == 3 and e.table("nodes").count() == 0
    (tmp_path / "cured").write_text("")
    assert e.insert_documents(docs) == 1 and len((tmp_path / "calls").read_text()) == 4
