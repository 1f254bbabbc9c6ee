"""Structured Streaming: keyed versions, expiry, and an idempotent ingest ledger."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

VERSION = "user_id long, event_type string, version long, value string, valid_from timestamp"
STATE = "version long, value string, at timestamp"


def folder_stream(spark: SparkSession, folder: str, file: str, schema) -> DataFrame:
    """A stream of the Parquet files in a folder whose name fits; new files are new data."""
    return spark.readStream.schema(schema).option("pathGlobFilter", file).option("recursiveFileLookup", "true").parquet(folder)


def next_versions(key, frames, state: GroupState):
    """Emit a row for each change of value of a key; equal values (trimmed, lower-cased) only move the clock.

    An event from before the last one of an earlier batch comes too late: it changes nothing.
    """
    version, value, at = state.get if state.exists else (0, None, None)
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    out, late = [], at
    for r in rows.itertuples(index=False):
        if late is not None and r.ts < late:
            continue
        if version == 0 or str(r.value).strip().lower() != str(value).strip().lower():
            version, value = version + 1, r.value
            out.append((key[0], key[1], version, value, r.ts))
        at = r.ts
    state.update((version, value, at))
    yield pd.DataFrame(out, columns=["user_id", "event_type", "version", "value", "valid_from"])


def stream_versions(events: DataFrame) -> DataFrame:
    """events (event_id, ts, user_id, event_type, value string) stream -> versions as they appear."""
    return events.groupBy("user_id", "event_type").applyInPandasWithState(next_versions, VERSION, STATE, "append", GroupStateTimeout.NoTimeout)


def expire_idle(key, frames, state: GroupState):
    """Keyed TTL: a key that hears nothing for a day of processing time is emitted as expired and forgotten."""
    if state.hasTimedOut:
        yield pd.DataFrame({"user_id": [key[0]], "n": [state.get[0]], "status": ["expired"]})
        state.remove()
        return
    n = (state.get[0] if state.exists else 0) + sum(len(f) for f in frames)
    state.update((n,))
    state.setTimeoutDuration(24 * 3600 * 1000)
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "status": ["active"]})


def stream_ttl(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").applyInPandasWithState(expire_idle, "user_id long, n long, status string", "n long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def run_to_end(stream: DataFrame, out: str, mode: str = "append") -> DataFrame:
    """Take all that is there in micro-batches, write it to Parquet, and read it back."""
    spark = stream.sparkSession
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-checkpoint").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def latest_activity(events: DataFrame, out: str) -> DataFrame:
    """user_id, n, status of ``stream_ttl`` after all that is there: the last update of each key."""
    spark = events.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream_ttl(events).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", out + "-checkpoint").trigger(once=True).start().awaitTermination()
    every = spark.read.option("basePath", out).parquet(out)
    return every.groupBy("user_id").agg(F.max_by(F.struct("n", "status"), "batch").alias("r")).select("user_id", "r.n", "r.status")


def ingest_ledger(stream: DataFrame, out: str) -> DataFrame:
    """Counts of each batch: rows, and ids that no earlier batch had.

    Ids seen are in the state store, by id over all partitions, so a batch looks up its own ids only and costs its own size, however
    many came before; nothing of earlier batches is read. A batch that is tried again starts from the same state and replaces its
    own folder, so it counts once. Ids are kept for good; where they come again only within a bounded time,
    give the stream a watermark and use ``dropDuplicatesWithinWatermark`` before this.
    """
    every = stream.select("event_type", F.lit(1).alias("n"), F.lit(0).alias("n_ids"))
    fresh = stream.dropDuplicates(["event_type", "event_id"]).select("event_type", F.lit(0).alias("n"), F.lit(1).alias("n_ids"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("n_ids").alias("n_ids")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    spark, key = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = every.union(fresh).writeStream.foreachBatch(write).option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)
    return spark.read.option("basePath", out).parquet(out)


REVISION = "user_id long, event_type string, kind string, revision long, version long, value string, valid_from timestamp"
SAID = "user_id long, event_type string, kind string, revision long, version long, value string, at long"
HELD = "keys binary, events binary"
KEY = ["no_user", "user_id", "event_type"]
#: Groups of keys that share a call and a state; a time that is null.
BUCKETS, MISSING = 1024, -(2**63)
_KEYS = pa.schema([("no_user", pa.bool_()), ("user_id", pa.int64()), ("event_type", pa.string()), ("version", pa.int64()), ("value", pa.string()), ("bound", pa.int64()), ("revision", pa.int64())])
_EVENTS = pa.schema([("k", pa.int64()), ("at", pa.int64()), ("no_id", pa.bool_()), ("event_id", pa.int64()), ("value", pa.dictionary(pa.int32(), pa.string()))])


def _norm(v) -> str:
    return str(v).strip().lower()


def _to_bytes(df: pd.DataFrame, schema: pa.Schema) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
        w.write_table(pa.Table.from_pandas(df, schema, preserve_index=False))
    return out.getvalue().to_pybytes()


def _from_bytes(b: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(pa.py_buffer(bytes(b))).read_all().to_pandas()


class _Ordered:
    """Events in order of key and time with the number of the version that each falls in; ``starts`` and ``sizes`` by key."""

    def __init__(self, k: np.ndarray, norm: np.ndarray, version: np.ndarray, last: np.ndarray):
        self.sizes = np.bincount(k, minlength=len(version))
        self.starts = np.cumsum(self.sizes) - self.sizes
        before = np.concatenate([[-1], norm[:-1]])
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])[: len(k)])
        before[first] = np.where(version[k[first]] > 0, last[k[first]], -1)
        self.changes = norm != before[: len(k)]
        c = np.concatenate([[0], np.cumsum(self.changes)])
        self.number = version[k] + c[1:] - c[self.starts[k]]
        self.n_changes = c[self.starts + self.sizes] - c[self.starts]
        self.at_change = np.flatnonzero(self.changes)


def revised_keys(horizon: dt.timedelta):
    """The state function of ``stream_revisions`` for the keys of a bucket.

    What it remembers of a key is its events within the horizon, and where versions stood before them. All keys of a
    bucket are sorted, numbered and compared at once as arrays, so a call costs its events, however many keys they have.
    Frames have no_user, user_id, event_type, no_id, event_id, at (microseconds, MISSING if null) and value.
    """
    span = horizon // dt.timedelta(microseconds=1)

    def run(key, frames, state: GroupState):
        keys, known = (_from_bytes(b) for b in state.get) if state.exists else (s.empty_table().to_pandas() for s in (_KEYS, _EVENTS))
        new = pd.concat(list(frames), ignore_index=True)
        at_key = pd.concat([keys[KEY], new[KEY]], ignore_index=True).groupby(KEY, sort=False, dropna=False).ngroup().to_numpy()
        old, size = len(keys), int(at_key.max()) + 1
        at_new = at_key[old:]
        fresh_key = np.unique(at_new, return_index=True)[1][np.unique(at_new) >= old]
        names = pd.concat([keys[KEY], new[KEY].iloc[fresh_key]], ignore_index=True)
        wider = lambda c, fill: np.concatenate([keys[c].to_numpy(np.int64), np.full(size - old, fill, np.int64)])
        version, bound, revision = wider("version", 0), wider("bound", MISSING), wider("revision", 0)
        late = (at_new < old) & (new["at"].to_numpy() < bound[at_new])
        late_rows = (at_new[late], revision[at_new[late]], new["value"].to_numpy(object)[late], new["at"].to_numpy()[late])

        e = pd.concat([known.astype({"value": object}), new[["at", "no_id", "event_id", "value"]][~late].assign(k=at_new[~late])], ignore_index=True)
        again = e.duplicated(["k", "no_id", "event_id"]).to_numpy() & ~e["no_id"].to_numpy(bool)
        fresh = (np.arange(len(e)) >= len(known))[~again]
        k, at, no_id, ids = (e[c].to_numpy(t)[~again] for c, t in (("k", np.int64), ("at", np.int64), ("no_id", bool), ("event_id", np.int64)))
        values = np.concatenate([e["value"].to_numpy(object)[~again], keys["value"].to_numpy(object)])
        code, said = pd.factorize(values, use_na_sentinel=False)
        said = np.array([None if pd.isna(v) else v for v in said], object)
        norm = pd.factorize(np.array([_norm(v) for v in said], object))[0][code] if len(code) else code
        last = np.concatenate([norm[len(k) :], np.full(size - old, -1)])
        code, norm = code[: len(k)], norm[: len(k)]

        order = np.lexsort((ids, no_id, at, k))
        k, at, no_id, ids, fresh, code, norm = (x[order] for x in (k, at, no_id, ids, fresh, code, norm))
        after, before = _Ordered(k, norm, version, last), _Ordered(k[~fresh], norm[~fresh], version, last)
        touched = np.bincount(k[fresh], minlength=size) > 0
        revision += touched
        # The j-th change of a key beside its j-th change before this batch.
        c, c0 = after.at_change, np.flatnonzero(~fresh)[before.at_change]
        j = np.arange(len(c)) - (np.cumsum(after.n_changes) - after.n_changes)[k[c]]
        there = j < before.n_changes[k[c]]
        beside = c0[((np.cumsum(before.n_changes) - before.n_changes)[k[c]] + j)[there]]
        moved = ~there
        moved[there] = (code[c[there]] != code[beside]) | (at[c[there]] != at[beside])
        c = c[moved & touched[k[c]]]

        some = after.sizes > 0
        latest = at[(after.starts + after.sizes - 1)[some]]
        bound[some] = np.maximum(bound[some], np.where(latest < MISSING + span, MISSING, latest - span))
        value = np.concatenate([keys["value"].to_numpy(object), np.full(size - old, None, object)])
        number, gone = after.number, at < bound[k]
        n_gone = np.bincount(k[gone], minlength=size)
        tail = (after.starts + n_gone - 1)[n_gone > 0]
        changed = np.maximum.accumulate(np.where(after.changes, np.arange(len(k)), -1)) if len(k) else np.zeros(0, np.int64)
        which, said_at = np.flatnonzero(n_gone), changed[tail]
        version[which] = number[tail]
        own = said_at >= after.starts[which]
        value[which[own]] = said[code[said_at[own]]]
        kept = ~gone
        state.update((
            _to_bytes(names.assign(version=version, value=value, bound=bound, revision=revision), _KEYS),
            _to_bytes(pd.DataFrame({"k": k[kept], "at": at[kept], "no_id": no_id[kept], "event_id": ids[kept], "value": said[code[kept]] if len(said) else np.zeros(0, object)}), _EVENTS),
        ))
        if n := len(c) + len(late_rows[0]):
            row = np.concatenate([k[c], late_rows[0]])
            yield pd.DataFrame({
                "user_id": pd.arrays.IntegerArray(names["user_id"].to_numpy(np.int64)[row], names["no_user"].to_numpy(bool)[row]),
                "event_type": names["event_type"].to_numpy(object)[row], "kind": np.repeat(np.array(["version", "late"], object), [len(c), n - len(c)]), "revision": np.concatenate([revision[k[c]], late_rows[1]]),
                "version": pd.arrays.IntegerArray(np.concatenate([number[c], np.zeros(n - len(c), np.int64)]), np.arange(n) >= len(c)),
                "value": np.concatenate([said[code[c]], late_rows[2]]), "at": np.concatenate([at[c], late_rows[3]]),
            })

    return run


def revised_versions(horizon: dt.timedelta):
    """``revised_keys`` for one key (user_id, event_type), with frames of event_id, ts and value."""
    of_keys = revised_keys(horizon)

    def run(key, frames, state: GroupState):
        def named(f):
            at, no_id = f["ts"].to_numpy().astype("datetime64[us]").astype("int64"), f["event_id"].isna()
            return pd.DataFrame({"no_user": key[0] is None, "user_id": key[0] or 0, "event_type": key[1], "no_id": no_id, "event_id": f["event_id"].fillna(0), "at": at, "value": f["value"]})

        for out in of_keys(key, [named(f) for f in frames], state):
            yield out.drop(columns="at").assign(valid_from=out["at"].to_numpy().astype("datetime64[us]"))

    return run


def stream_revisions(events: DataFrame, horizon: dt.timedelta, buckets: int = BUCKETS) -> DataFrame:
    """events (event_id, ts, user_id, event_type, value string) stream in any order -> versions of each key, corrected as late events come.

    An event that comes after later ones re-opens the versions from its time on: those that it changes are emitted once more with a higher revision. An
    event more than ``horizon`` behind the latest of its key changes nothing; it comes out as a row of kind ``late``. Ids that come again
    within the horizon count once. The state of a key is its events within the horizon.

    Keys are dealt to ``buckets`` by hash, and those of a bucket share a call of Python and a state: a batch reads and writes
    the buckets that it touches. Few are fast for large batches; where batches are small, take so many that a bucket
    holds few events. The number stays with the checkpoint.
    """
    e = events.select(
        F.pmod(F.xxhash64("user_id", "event_type"), F.lit(buckets)).alias("bucket"), F.isnull("user_id").alias("no_user"), F.coalesce("user_id", F.lit(0)).alias("user_id"), "event_type",
        F.isnull("event_id").alias("no_id"), F.coalesce("event_id", F.lit(0)).alias("event_id"), F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(MISSING)).alias("at"), "value",
    )
    said = e.groupBy("bucket").applyInPandasWithState(revised_keys(horizon), SAID, HELD, "append", GroupStateTimeout.NoTimeout)
    return said.select("user_id", "event_type", "kind", "revision", "version", "value", F.when(F.col("at") != MISSING, F.timestamp_micros("at")).alias("valid_from"))


def current_versions(revisions: DataFrame) -> DataFrame:
    """user_id, event_type, version, value, valid_from: each version as last revised. An event more never makes fewer versions, so a version's last revision is what holds."""
    last = revisions.filter("kind = 'version'").groupBy("user_id", "event_type", "version").agg(F.max_by(F.struct("value", "valid_from"), "revision").alias("r"))
    return last.select("user_id", "event_type", "version", "r.value", "r.valid_from")
