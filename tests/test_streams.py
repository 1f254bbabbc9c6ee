"""Streams over more than one batch: late events, ids that come again, and expiry with a clock of its own."""

import datetime as dt
import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnweave.streaming import state

T = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value string"


def event(i, minutes, value, kind="a"):
    return (i, T + dt.timedelta(minutes=minutes), 1, kind, value)


def in_batches(spark, folder, batches):
    """A stream that takes a file a batch."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{n}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(folder)


def test_ids_that_come_again_count_once(spark, tmp_path):
    s = in_batches(spark, str(tmp_path / "in"), [[event(1, 0, "x"), event(2, 1, "x")], [event(2, 1, "x"), event(3, 2, "x", "b"), event(2, 1, "x")]])
    out = state.ingest_ledger(s, str(tmp_path / "out"))
    got = {r["event_type"]: (r["n"], r["n_ids"]) for r in out.groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("n_ids").alias("n_ids")).collect()}
    assert out.select("batch").distinct().count() == 2 and got == {"a": (4, 2), "b": (1, 1)}


def test_late_events_make_no_version(spark, tmp_path):
    s = in_batches(spark, str(tmp_path / "in"), [[event(1, 0, "x"), event(2, 10, "y")], [event(3, 5, "x"), event(4, 20, "Y "), event(5, 30, "z")]])
    rows = state.run_to_end(state.stream_versions(s), str(tmp_path / "out")).orderBy("version").collect()
    assert [(r["version"], r["value"]) for r in rows] == [(1, "x"), (2, "y"), (3, "z")]


class Clock:
    """A group state whose time is set by hand."""

    def __init__(self):
        self.value, self.hasTimedOut, self.timeout = None, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_idle_keys_expire():
    clock = Clock()
    frames = [pd.DataFrame({"event_id": [1, 2]})]
    assert next(state.expire_idle((7,), frames, clock)).to_dict("records") == [{"user_id": 7, "n": 2, "status": "active"}]
    assert next(state.expire_idle((7,), frames, clock))["n"][0] == 4 and clock.timeout == 24 * 3600 * 1000
    clock.hasTimedOut = True
    with pytest.raises(StopIteration):
        it = state.expire_idle((7,), [], clock)
        assert next(it)["status"][0] == "expired"
        next(it)
    assert not clock.exists


def test_batches_in_any_order_give_the_same_versions(spark, tmp_path):
    """Late events re-open versions; what is read at the end is what one batch in order of time gives."""
    batches = [[event(1, 0, "x"), event(4, 30, "x"), event(5, 40, "z")], [event(2, 10, " X "), event(3, 20, "y"), event(9, 5, "q", "b")], [event(6, 50, "z"), event(3, 20, "y"), event(7, 35, "w")]]
    want = [(1, "x", 0), (2, "y", 20), (3, "x", 30), (4, "w", 35), (5, "z", 40)]
    for n, order in enumerate(itertools.permutations(batches)):
        s = in_batches(spark, str(tmp_path / f"in{n}"), order)
        out = state.run_to_end(state.stream_revisions(s, dt.timedelta(days=1)), str(tmp_path / f"out{n}"))
        rows = state.current_versions(out).filter("event_type = 'a'").orderBy("version").collect()
        assert [(r["version"], r["value"].strip().lower(), (r["valid_from"] - T).seconds // 60) for r in rows] == want
        assert out.filter("kind = 'late'").count() == 0


def test_only_changed_versions_come_again():
    clock, run = Clock(), state.revised_versions(dt.timedelta(days=1))
    frame = lambda *rows: [pd.DataFrame([(i, T + dt.timedelta(minutes=m), v) for i, m, v in rows], columns=["event_id", "ts", "value"])]
    said = lambda frames: [(r.revision, r.version, r.value) for f in run((1, "a"), frames, clock) for r in f.itertuples()]
    assert said(frame((1, 0, "x"), (2, 10, "y"), (3, 20, "z"))) == [(1, 1, "x"), (1, 2, "y"), (1, 3, "z")]
    assert said(frame((3, 20, "z"))) == []
    assert said(frame((4, 15, "w"))) == [(2, 3, "w"), (2, 4, "z")]


def test_events_behind_the_horizon_come_out_as_late(spark, tmp_path):
    s = in_batches(spark, str(tmp_path / "in"), [[event(1, 0, "x"), event(2, 100, "y")], [event(3, 1, "q"), event(4, 95, "x"), event(5, 200, "y")], [event(6, 150, "x")]])
    out = state.run_to_end(state.stream_revisions(s, dt.timedelta(minutes=60)), str(tmp_path / "out"))
    assert [(r["value"], r["valid_from"]) for r in out.filter("kind = 'late'").collect()] == [("q", T + dt.timedelta(minutes=1))]
    rows = state.current_versions(out).orderBy("version").collect()
    assert [(r["version"], r["value"]) for r in rows] == [(1, "x"), (2, "y"), (3, "x"), (4, "y")]


def test_the_ledger_reads_no_earlier_batch(spark, tmp_path):
    s = in_batches(spark, str(tmp_path / "in"), [[event(i, 0, "x"), event(i + 1, 0, "x")] for i in range(6)])
    out = state.ingest_ledger(s, str(tmp_path / "out"))
    assert [(r["n"], r["n_ids"]) for r in out.orderBy("batch").collect()] == [(2, 2)] + [(2, 1)] * 5
    assert not (tmp_path / "out-ids").exists()


def test_keys_share_calls_and_states(spark, tmp_path):
    """There are no more states than buckets, however many keys; each key's versions are those of its events in order of time."""
    rows = [(i, T + dt.timedelta(minutes=i * 7919 % 6007), None if i % 3001 == 3000 else i % 3001, None if i % 7 == 0 else "ab"[i % 2], f" {'xyz'[i * i % 3]} ") for i in range(6002)]
    s = in_batches(spark, str(tmp_path / "in"), [rows[1::2], rows[::2] + rows[1:200:2]])
    out = state.run_to_end(state.stream_revisions(s, dt.timedelta(days=30)), str(tmp_path / "out"))
    want, last = set(), {}
    for _, at, user, kind, value in sorted(rows, key=lambda r: (r[1], r[0])):
        n, before = last.get((user, kind), (0, None))
        if value != before:
            want.add((user, kind, n + 1, value, at))
        last[user, kind] = (n + (value != before), value)
    got = [tuple(r) for r in state.current_versions(out).collect()]
    assert len(last) > 3001 and len(got) == len(want) and set(got) == want
    assert spark.read.format("statestore").load(str(tmp_path / "out-checkpoint")).count() <= 1024


def test_a_bucket_keeps_its_keys_apart():
    """Keys in one call against a call for each key: late events, ids that come again, keys without a name."""
    r = random.Random(5)
    plain = lambda v: None if pd.isna(v) else v if isinstance(v, str) else int(v)
    for days in (1, 40):
        many, clock, alone = state.revised_keys(dt.timedelta(days=days)), Clock(), {}
        for _ in range(5):
            rows = [(r.choice([None, 1, 2, 2**60 + 1]), r.choice([None, "a"]), r.randrange(80), r.randrange(30), r.choice(["x", " X", "y", None])) for _ in range(60)]
            frame = pd.DataFrame({"no_user": [u is None for u, *_ in rows], "user_id": [u or 0 for u, *_ in rows], "event_type": pd.Series([x[1] for x in rows], dtype=object), "no_id": False, "event_id": [x[2] for x in rows], "at": [x[3] * 86_400_000_000 for x in rows], "value": [x[4] for x in rows]})
            got = [(plain(x.user_id), plain(x.event_type), x.kind, int(x.revision), plain(x.version), plain(x.value), x.at // 86_400_000_000) for f in many((0,), [frame], clock) for x in f.itertuples(index=False)]
            want = []
            for key in dict.fromkeys((u, k) for u, k, *_ in rows):
                own = [x for x in rows if x[:2] == key]
                f = pd.DataFrame({"event_id": [x[2] for x in own], "ts": pd.to_datetime([x[3] for x in own], unit="D"), "value": pd.Series([x[4] for x in own], dtype=object)})
                run, held = alone.setdefault(key, (state.revised_versions(dt.timedelta(days=days)), Clock()))
                want += [(*key, x.kind, int(x.revision), plain(x.version), plain(x.value), (x.valid_from - pd.Timestamp(0)).days) for g in run(key, [f], held) for x in g.itertuples(index=False)]
            assert sorted(map(str, got)) == sorted(map(str, want)) and got
