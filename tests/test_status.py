"""Status records: the state machine, retries and stale records."""

import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.config import resolve
from lodestone.errors import StorageError
from lodestone.operators import status


class Clock:
    def __init__(self):
        self.at = datetime.datetime(2026, 1, 1)

    def __call__(self):
        return F.lit(self.at)


@pytest.fixture
def clock():
    return Clock()


@pytest.fixture
def store(spark, tmp_path, clock):
    return status.StatusStore(spark, str(tmp_path / "status"), clock)


def states(store):
    return {r["source"]: r["status"] for r in store.records().collect()}


def test_life_of_a_file(store):
    assert store.records().count() == 0 and store.due().count() == 0
    store.mark_pending(["a", "b", "a"], "disk")
    store.update_stage(["a", "b"], "Embedding", 3)
    store.mark_done("a", 7)
    store.mark_skipped("b", "same")
    got = {r["source"]: r for r in store.records().collect()}
    assert states(store) == {"a": "done", "b": "skipped"} and got["a"]["chunks"] == 7 and got["a"]["source_name"] == "disk" and got["b"]["error"] == "same"
    with pytest.raises(StorageError):
        store.mark_done("a")
    assert states(store)["a"] == "done"
    store.mark_deleted("b")
    assert {r["source"]: r["source_name"] for r in store.records("skipped").collect()} == {"b": None}
    assert {r["status"]: r["n"] for r in store.summary().collect()}["done"] == 1 and store.listed(limit=1).count() == 1
    store.mark_done([])
    with pytest.raises(StorageError):
        store.mark_done("new")  # pending to done is no step


def test_retries(store, clock, spark):
    failures = spark.createDataFrame([("a", "timeout", "ConversionTimeoutError"), ("b", "broken", "CorruptedDocumentError"), ("c", "gateway", None), ("c", "gateway", None)], "source string, error string, error_type string")
    status.schedule(store, failures)
    assert states(store) == {"a": "retry", "b": "failed", "c": "retry"} and store.due().count() == 0
    clock.at += datetime.timedelta(seconds=60)
    assert sorted(r["source"] for r in store.due().collect()) == ["a", "c"]
    folded = status.fold_in(spark.createDataFrame([("a", "unchanged"), ("x", "unchanged"), ("c", "delete")], "source string, action string"), store.due())
    assert {tuple(r) for r in folded.collect()} == {("a", "ingest"), ("x", "unchanged"), ("c", "delete")}
    assert status.process(store, lambda due: failures.filter("source = 'a'")) == 1
    assert states(store) == {"a": "retry", "b": "failed", "c": "processing"}
    assert store.records("retry").head()["attempts"] == 2 and store.due().count() == 0
    for n in (300, 1800, 7200):
        clock.at += datetime.timedelta(seconds=n)
        assert status.process(store, lambda due: failures.filter("source = 'a'")) == 0
    assert states(store)["a"] == "failed" and status.process(store, lambda due: due) == 0
    assert status.reset_failed(store, "zz") == 0 and status.reset_failed(store) == 2 and set(states(store).values()) == {"processing"}


def test_auto_retries_end(store, spark):
    bad = spark.createDataFrame([("a", "broken", "ConfigError")], "source string, error string, error_type string")
    for n in range(3):
        status.schedule(store, bad, auto_most=2)
        assert states(store)["a"] == ("retry" if n < 2 else "failed")


def test_stale(store, clock):
    store.update_stage(["a", "b"], "Storing")
    clock.at += datetime.timedelta(days=8)
    store.update_stage("b", "Storing")
    assert store.cleanup_stale() == 1 and states(store) == {"a": "failed", "b": "processing"} and store.cleanup_stale() == 0


def test_unset_variables_stay(monkeypatch):
    monkeypatch.setenv("SET", "x")
    assert resolve("${SET}/${NOT_SET_HERE}/${NOT_SET_HERE:-y}/${NOT_SET_HERE:-}") == "x/${NOT_SET_HERE}/y/"
