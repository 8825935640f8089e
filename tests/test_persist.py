"""Micro-batches persisted with a ledger: replays change nothing, half-written batches are not seen, and the stream goes on after a failure."""

import pytest
from pyspark.sql import functions as F

from folioscan.operators import quarantine
from folioscan.streaming import ingest, persist

SCHEMA = "doc_id long, text string, content_hash string"


def link(events):
    return events.select("doc_id", "content_hash", F.explode(F.array(F.col("doc_id") % 2, F.lit(7).cast("long"))).alias("entity_id"))


def land(spark, folder, rows):
    spark.createDataFrame([(d, t, t) for d, t in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def state(spark, root):
    return sorted((r.entity_id, r.doc_id, r.version_number, r.is_current) for r in persist.current_versions(spark, root).collect())


def test_batches_are_whole_or_unseen(spark, tmp_path, monkeypatch):
    root, landed, checkpoint = (str(tmp_path / x) for x in ("root", "landed", "state"))
    go = lambda: persist.run(ingest.landed(spark, landed, SCHEMA), root, checkpoint, link, ["doc_id"])
    land(spark, landed, [(1, "a"), (2, "b"), (3, "a")])
    go()
    first = [(0, 2, 1, True), (1, 1, 1, True), (7, 1, 1, False), (7, 2, 2, True)]
    assert state(spark, root) == first
    land(spark, landed, [(4, "c"), (5, "b"), (6, None)])
    save = persist._save

    def broken(df, root, name, batch):
        if name == "versions":
            raise RuntimeError("lost between two tables")
        return save(df, root, name, batch)

    monkeypatch.setattr(persist, "_save", broken)
    with pytest.raises(Exception, match="lost between"):
        go()
    assert state(spark, root) == first  # events and links of the broken batch are there, but not in the ledger
    assert spark.read.parquet(f"{root}/events/*").count() == 4 and persist.committed(spark, root, "events").count() == 2
    monkeypatch.setattr(persist, "_save", save)
    go()
    whole = [(0, 2, 1, False), (0, 4, 2, False), (0, 6, 3, True), (1, 1, 1, True), (7, 1, 1, False), (7, 2, 2, False), (7, 4, 3, False), (7, 6, 4, True)]
    assert state(spark, root) == whole
    persist.batch_writer(root, link, ["doc_id"])(spark.createDataFrame([(4, "c", "c"), (6, None, None)], SCHEMA), 1)
    assert state(spark, root) == whole
    go()  # nothing has landed
    assert state(spark, root) == whole


def test_quarantine_counts_and_reasons(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, "x"), (2, 5, " \n "), (3, 6, None), (4, 7, "fine"), (4, 7, "fine"), (None, None, None)], "doc_id long, version_id long, text string")
    good, rejected, n = quarantine.split(rows, quarantine.analysis_rules(), str(tmp_path / "q"))
    assert sorted(r.doc_id for r in good.collect()) == [4, 4] and good.columns == rows.columns
    assert n == {"rows": 6, "rejected": 4, "no current version": 2, "version has no text": 2}
    assert {(r.doc_id, r.error) for r in quarantine.failures(rejected, "doc_id").collect()} == {(1, "no current version"), (None, "no current version"), (2, "version has no text"), (3, "version has no text")}
    good, rejected, n = quarantine.split(rows.limit(0), quarantine.analysis_rules(), str(tmp_path / "e"))
    assert good.count() == rejected.count() == n["rows"] == 0


def test_the_first_copy_in_order_is_the_event(spark, tmp_path):
    root, landed, checkpoint = (str(tmp_path / x) for x in ("root", "landed", "state"))
    go = lambda: persist.run(ingest.landed(spark, landed, SCHEMA), root, checkpoint, link, ["doc_id"])
    rows = [(d, f"t{d % 20}" if d % 20 else None) for d in range(4000)]
    for part in (rows[:2000], rows[2000:]):
        land(spark, landed, part[:20])
        land(spark, landed, part[20:])  # the larger file is read first, but its copies are not the first in order
        go()
    assert sorted(r.doc_id for r in persist.committed(spark, root, "events").collect()) == list(range(20))
