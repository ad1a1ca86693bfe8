"""Malformed polls go to a table of their own, once each."""
import json
import os
import tempfile

from contrail.sources import live as L
from contrail.sources.store import BatchTable
from contrail.streaming import live as S

GOOD = ["abc123", "DLH123  ", "Germany", 1700000000, 1700000001, 8.56, 50.03, 10600, False, 240.0,
        90.0, 0.0, None, 10650, "1000", False, 0]


def _changed(**at):
    s = list(GOOD)
    for f, v in at.items():
        s[L.STATE_FIELDS.index(f)] = v
    return s


LINES = [
    json.dumps({"time": 1700000000, "states": [GOOD, GOOD[:6], _changed(latitude="north"), None]}),
    json.dumps({"time": 1700000060, "states": [_changed(on_ground=True), _changed(longitude=None)]}),
    '{"time": 1700000120, "states": [["cut',
    json.dumps({"time": None, "states": [GOOD]}),
    json.dumps({"time": 1700000180, "states": None}),
]


def _landing():
    d = tempfile.mkdtemp(prefix="contrail-landing-")
    for i, line in enumerate(LINES):
        with open(os.path.join(d, f"poll-{i}.json"), "w") as fh:
            fh.write(line + "\n")
    return d


def test_good_states_and_dead_letters(spark):
    run = S.new_run_dir(spark, "test-rejects")
    q = S.ingest_checked(S.checked_stream(spark, _landing(), max_files_per_trigger=2),
                         f"{run}/good", f"{run}/bad", f"{run}/ckpt")
    S.run_to_completion(q)
    good, bad = BatchTable(spark, f"{run}/good"), BatchTable(spark, f"{run}/bad")
    assert [(r.icao24, r.latitude) for r in good.read().collect()] == [("abc123", 50.03)]
    got = sorted((r.reason, r.icao24 or "", r.source) for r in bad.read().collect())
    assert got == sorted([("no poll time", "abc123", "poll-3.json"), ("no states", "", "poll-0.json"),
                          ("no states", "", "poll-4.json"), ("position is not a number", "abc123", "poll-0.json"),
                          ("short state", "abc123", "poll-0.json"), ("unreadable line", "", "poll-2.json")])
    assert {r.report for r in bad.read().where("reason = 'unreadable line'").collect()} == {LINES[2]}
    assert good.batches() == bad.batches() == ["epoch-0", "epoch-1", "epoch-2"]
    seen = [p.observedMetrics["states"] for p in q.recentProgress if "states" in (p.observedMetrics or {})]
    assert sum(m["all"] for m in seen) == 9 and sum(m["rejected"] for m in seen) == 6


def test_a_replayed_epoch_changes_nothing(spark):
    run, landing = S.new_run_dir(spark, "test-replay"), _landing()
    raw = (spark.read.schema(L.CHECKED_SCHEMA).option("columnNameOfCorruptRecord", "_line").json(landing)
           .selectExpr("*", "_metadata.file_name AS source"))
    batch = L.checked_states(raw)
    write = S.write_both(f"{run}/good", f"{run}/bad")
    tables = [BatchTable(spark, f"{run}/{n}") for n in ("good", "bad")]
    write(batch, 0)
    before = [sorted(map(str, t.read().collect())) for t in tables]
    write(batch, 0)
    tables[0].stage(tables[0].read())          # a crash between the two writes of the epoch
    assert [sorted(map(str, t.read().collect())) for t in tables] == before
    write(batch.where("reason = 'short state'"), 1)
    assert tables[1].read().count() == len(before[1]) + 1 and tables[0].read().count() == len(before[0])
