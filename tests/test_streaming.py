"""Streams run in one and in several micro-batches, started again, and compared with the batch result."""

import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallymark.operators.changes import upsert_latest
from tallymark.registry.windows import lines_of
from tallymark.sources.tables import SCHEMAS, Tables
from tallymark.streaming import feeds, stores
from tallymark.streaming.stores import Snapshot

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "in")
    spark.read.schema(SCHEMAS["events"]).parquet(EVENTS).repartition(5, "event_id").write.parquet(path)
    return path


def source(spark, parts, files):
    return feeds.change_feed_source(spark, parts, SCHEMAS["events"], max_files=files)


def rows(df):
    return sorted(map(tuple, df.select("user_id", "event_id", "event_type").collect()))


@pytest.mark.parametrize("files", [5, 1])
def test_upsert_equals_batch(spark, parts, files):
    batch = spark.read.schema(SCHEMAS["events"]).parquet(parts)
    got = feeds.stream_upsert(source(spark, parts, files), ["user_id"], ["ts", "event_id"])
    assert rows(got) == rows(upsert_latest(batch, ["user_id"], ["ts", "event_id"]))


def latest(df):
    return upsert_latest(df, ["k"], ["t"])


def batches(n, keys=7):
    return [[(k * n % keys, 100 * b + k, f"{b}.{k}") for k in range(5)] for b in range(n)]


def snapshot(spark, folder, fold_every=3):
    return Snapshot(spark, folder, StructType.fromDDL(SCHEMA), latest, fold_every)


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


SCHEMA = "k int, t int, v string"


@pytest.mark.parametrize("fold_every", [1, 3, 100])
def test_snapshot_equals_a_fold_of_all_batches(spark, tmp_path, fold_every):
    table, data = snapshot(spark, str(tmp_path), fold_every), batches(8)
    assert table.read().collect() == []
    for number, rows_ in enumerate(data):
        table.apply(frame(spark, rows_), number)
        assert len(table.current().deltas) < fold_every  # what a read has to fold does not grow with the batches
    want = {}
    for row in sum(data, []):
        want[row[0]] = max(want.get(row[0], row), row, key=lambda r: r[1])
    assert sorted(map(tuple, table.read().collect())) == sorted(want.values())
    parts = [p for p in os.listdir(tmp_path / "parts") if not p.startswith(".")]
    assert len(parts) <= 2 * fold_every + 2 and len([v for v in os.listdir(tmp_path / "versions") if v.endswith(".json") and v[0] != "."]) <= 2


def test_snapshot_after_a_crash_before_its_pointer(spark, tmp_path, monkeypatch):
    """The files of a batch are written, the pointer is not: readers see the version before, and the replay brings the batch."""
    table, data = snapshot(spark, str(tmp_path)), batches(4)
    for number in range(2):
        table.apply(frame(spark, data[number]), number)
    before = sorted(map(tuple, table.read().collect()))

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(stores.files, "publish", crash)
        with pytest.raises(OSError):
            table.apply(frame(spark, data[2]), 2)  # the third one also folds a new base
    assert {p for p in os.listdir(tmp_path / "parts") if "000002" in p} == {"delta-000000000002", "base-000000000002"}
    again = snapshot(spark, str(tmp_path))
    assert sorted(map(tuple, again.read().collect())) == before
    again.apply(frame(spark, data[2]), 2)
    whole = sorted(map(tuple, latest(frame(spark, sum(data[:3], []))).collect()))
    assert sorted(map(tuple, again.read().collect())) == whole
    again.apply(frame(spark, [(0, 10**6, "a replay with other rows")]), 2)  # published already
    assert sorted(map(tuple, again.read().collect())) == whole


def test_a_reader_of_the_version_before_can_finish(spark, tmp_path):
    table, data = snapshot(spark, str(tmp_path), 2), batches(3)
    table.apply(frame(spark, data[0]), 0)
    reader = table.read()
    table.apply(frame(spark, data[1]), 1)
    assert sorted(map(tuple, reader.collect())) == sorted(map(tuple, latest(frame(spark, data[0])).collect()))


def test_restart_takes_in_new_and_late_files(spark, tmp_path):
    feed, folder = str(tmp_path / "feed"), str(tmp_path / "job")
    seen, schema = [], "k int, ts int, v string"
    for arrival in ([(1, 5, "a"), (2, 5, "b")], [(1, 3, "late"), (3, 9, "new")], [], [(2, 6, "b2")]):
        if arrival:
            spark.createDataFrame(arrival, schema).coalesce(1).write.mode("append").parquet(feed)
        seen += arrival
        stream = feeds.change_feed_source(spark, feed, schema, time_column=None)
        got = feeds.stream_upsert(stream, ["k"], ["ts"], folder, fold_every=2)
        want = {k: max((r for r in seen if r[0] == k), key=lambda r: r[1]) for k, *_ in seen}
        assert sorted(map(tuple, got.collect())) == sorted(want.values())


CHANGES = "company_id int, project_id int, month int, change_id int, planned_amount decimal(20,2), actual_amount decimal(20,2)"


def test_audit_keeps_who_came_first(spark, tmp_path, monkeypatch):
    """A key is created by the first batch that brings it, even if a smaller change comes later; a replay changes nothing."""
    feed, folder, keys = str(tmp_path / "feed"), str(tmp_path / "job"), ["company_id", "project_id", "month"]
    arrivals = [[(1, 1, 1, 50, 10, 12), (1, 1, 1, 60, 10, 12), (2, 1, 1, 55, 0, 1)], [(1, 1, 1, 5, 10, 12), (1, 2, 1, 6, 4, 4)], [(1, 2, 1, 7, 4, 5)]]
    crashed = []
    real = stores.Snapshot.commit

    def commit(self, version):
        real(self, version)
        if version.batch == 1 and not crashed:
            crashed.append(True)
            raise OSError("lost after the state was published")

    monkeypatch.setattr(stores.Snapshot, "commit", commit)
    for arrival in arrivals:
        rows_ = [(*r[:4], Decimal(r[4]), Decimal(r[5])) for r in arrival]
        spark.createDataFrame(rows_, CHANGES).coalesce(1).write.mode("append").parquet(feed)
        for _ in range(2):  # the second start repeats a batch that was lost, or finds nothing
            stream = feeds.change_feed_source(spark, feed, CHANGES, time_column=None)
            try:
                audit = feeds.stream_budget_audit(stream, lambda batch: batch, keys, "change_id", folder)
            except Exception as lost:  # noqa: BLE001
                assert "lost after" in str(lost)
    assert crashed
    got = {r.change_id: r.action for r in audit.collect()}
    assert got == {50: "created", 60: "updated", 55: "created", 5: "updated", 6: "created", 7: "updated"} and audit.count() == 6


def test_lines_read_follow_the_batch(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    batch = t.orders.filter("o_orderkey BETWEEN 100 AND 120")
    plan = lines_of(t.lineitem, batch)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(l_orderkey,100)" in plan and "LessThanOrEqual(l_orderkey,120)" in plan
    assert lines_of(t.lineitem, batch).count() == t.lineitem.filter("l_orderkey BETWEEN 100 AND 120").count()
    assert lines_of(t.lineitem, t.orders.filter("false")).count() == 0


def test_outputs_show_only_what_the_ledger_names(spark, tmp_path, monkeypatch):
    schema = StructType.fromDDL("v int")
    out = stores.Outputs(spark, str(tmp_path), schema, ("even", "odd"))

    def routed(values):
        return spark.createDataFrame([(v, "odd" if v % 2 else "even") for v in values], "v int, sink string")

    def seen():
        return [sorted(r.v for r in out.read(s).collect()) for s in ("even", "odd")]

    assert seen() == [[], []] and out.ledger().collect() == []
    out.write(0, routed([1, 2, 3]))
    with monkeypatch.context() as broken:
        broken.setattr(stores.files, "publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            out.write(1, routed([5]))
    assert seen() == [[2], [1, 3]]
    out.write(1, routed([5]))
    out.write(1, routed([5, 5, 8]))  # a batch in the ledger is not written again
    assert seen() == [[2], [1, 3, 5]]
    assert sorted(map(tuple, out.ledger().collect())) == [(0, "even", 1), (0, "odd", 2), (1, "even", 0), (1, "odd", 1)]


def test_windowed_counts_match_closed_windows(spark, parts):
    stream = source(spark, parts, 1)
    counts = feeds.append_stream(stream, "w", lambda df: feeds.windowed_counts(df, "ts", "event_type", "1 day", "40 days"))
    # the delay is longer than the data: no window is ever closed
    assert counts.count() == 0


def test_audit_quarantine(spark):
    df = spark.createDataFrame([(1, 1, "task_sync", "n8n", "r", "created", "{}"), (2, 1, "bad", "n8n", "r", "created", "{}"),
                                (3, 1, None, "n8n", "r", "created", "{}")],
                               "event_id int, company_id int, workflow_type string, source_system string, source_record_id string,"
                               " action string, props string").withColumn("created_at", F.current_timestamp())
    routed = feeds.split_audit(feeds.audit_rows(df)).orderBy("event_id").collect()
    assert [r.sink for r in routed] == ["accepted", "quarantine", "quarantine"]
