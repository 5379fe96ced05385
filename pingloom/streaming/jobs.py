"""Incremental jobs: the same functions run on batches of a stream and on whole tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.storage import stored
from ..operators.ordered import chains, laid_out, with_running
from ..operators.scalar import contact_priority

DISPOSITION = {"CONFIRMED": "CONFIRMED", "REJECTED": "REJECTED"}


def review_state(events: DataFrame) -> DataFrame:
    """Latest verdict, number of verdicts and disposition of each contact. Raw fields never change."""
    return (
        events.filter("verdict is not null")
        .groupBy("contact_id")
        .agg(F.max(F.struct("created_at", "event_id", "verdict")).alias("last"), F.count("*").alias("review_count"))
        .select("contact_id", F.col("last.verdict").alias("latest_verdict"), "review_count", "last")
        .withColumn("disposition", F.when(F.col("latest_verdict").isin(*DISPOSITION), F.col("latest_verdict")).otherwise("UNRESOLVED"))
    )


def merged_state(old: DataFrame, batch: DataFrame) -> DataFrame:
    """State after a batch of events: counts add, the later verdict stays. Order and repeats of batches of new events do not matter."""
    new = review_state(batch)
    both = old.unionByName(new).groupBy("contact_id").agg(F.max("last").alias("last"), F.sum("review_count").alias("review_count"))
    return both.select("contact_id", F.col("last.verdict").alias("latest_verdict"), "review_count", "last").withColumn("disposition", F.when(F.col("latest_verdict").isin(*DISPOSITION), F.col("latest_verdict")).otherwise("UNRESOLVED"))


def with_priority(contacts: DataFrame, state: DataFrame) -> DataFrame:
    """Contacts with the state of their reviews and their priority derived anew: a verdict is one of its inputs."""
    joined = contacts.drop("latest_verdict").join(state.select("contact_id", "latest_verdict", "review_count", "disposition"), "contact_id", "left")
    return contact_priority(joined.withColumns({"review_count": F.coalesce("review_count", F.lit(0)), "disposition": F.coalesce("disposition", F.lit("UNREVIEWED"))}))


def _batches(spark: SparkSession, path: str, schema: str, before: int) -> DataFrame:
    """What batches earlier than ``before`` have written under ``path``, a folder for each."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").parquet(path).filter(F.col("batch") < before)


REVIEW_STATE = "contact_id string, latest_verdict string, review_count long, last struct<created_at:timestamp,event_id:long,verdict:string>, disposition string"


def latest_reviews(spark: SparkSession, table_path: str, before: int = 1 << 62) -> DataFrame:
    """The newest state of each contact that ``run_reviews`` has written."""
    rows = _batches(spark, f"{table_path}/state", REVIEW_STATE, before)
    return rows.groupBy("contact_id").agg(F.max_by(F.struct("latest_verdict", "review_count", "last", "disposition"), "batch").alias("s")).select("contact_id", "s.*")


def run_reviews(stream: DataFrame, table_path: str, checkpoint: str, contacts: DataFrame | None = None):
    """Append new verdict events under ``table_path``/events, and the new state of the contacts they name under /state and, with their priority, /contacts.

    Each batch has folders of its own and reads only what earlier batches left, so a batch that is run again writes
    the same once more. Only contacts with new events are written.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{table_path}/events/batch={batch_id}")
        batch = spark.read.schema(batch.schema).parquet(f"{table_path}/events/batch={batch_id}")
        named = batch.filter("verdict is not null").select("contact_id").distinct()
        old = latest_reviews(spark, table_path, batch_id).join(named, "contact_id", "left_semi")
        merged_state(old.select(review_state(batch).columns), batch).select("contact_id", "latest_verdict", "review_count", "last", "disposition").write.mode("overwrite").parquet(f"{table_path}/state/batch={batch_id}")
        if contacts is not None:
            state = spark.read.parquet(f"{table_path}/state/batch={batch_id}")
            with_priority(contacts.join(named, "contact_id", "left_semi"), state).write.mode("overwrite").parquet(f"{table_path}/contacts/batch={batch_id}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


UPLOAD_KEYS = "mission string, sha string, earlier long"


def split_uploads(known: DataFrame, batch: DataFrame) -> DataFrame:
    """Uploads (upload_id, mission, sha) with ``earlier`` and ``rejected``: the same content in the same mission is taken once.

    ``known`` (mission, sha, earlier): what was taken before; within the batch the smallest id is taken. Content
    without a digest is never a duplicate.
    """
    first = batch.groupBy("mission", "sha").agg(F.min("upload_id").alias("_first"))
    out = batch.alias("b").join(first.alias("f"), _same_upload("b", "f")).join(known.alias("k"), _same_upload("b", "k"), "left")
    out = out.select("b.*", F.when(F.col("b.sha").isNotNull(), F.coalesce("k.earlier", "f._first")).otherwise(F.col("b.upload_id")).alias("earlier"))
    return out.withColumn("rejected", F.col("earlier") != F.col("upload_id"))


def _same_upload(a: str, b: str):
    return F.col(f"{a}.mission").eqNullSafe(F.col(f"{b}.mission")) & F.col(f"{a}.sha").eqNullSafe(F.col(f"{b}.sha"))


def run_uploads(stream: DataFrame, table_path: str, checkpoint: str):
    """Register uploads under ``table_path``/uploads (with the earlier id where rejected) and their keys under /keys.

    The keys are the state: a batch joins them with those of earlier batches only, so running it again, also after a
    failure between its two writes, gives the same.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = _batches(spark, f"{table_path}/keys", UPLOAD_KEYS, batch_id).drop("batch")
        split_uploads(known, batch).write.mode("overwrite").parquet(f"{table_path}/uploads/batch={batch_id}")
        done = spark.read.parquet(f"{table_path}/uploads/batch={batch_id}")
        done.filter("not rejected and sha is not null").select("mission", "sha", F.col("upload_id").alias("earlier")).write.mode("overwrite").parquet(f"{table_path}/keys/batch={batch_id}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_writes(stored: DataFrame, batch: DataFrame, key: list[str], order: list) -> DataFrame:
    """Rows of a batch whose key is new: existing ones are never overwritten, and the first of a batch wins."""
    from pyspark.sql import Window as W

    fresh = batch.join(stored.select(*key), key, "left_anti")
    return fresh.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def sessions(events: DataFrame, key: str, gap: str = "30 seconds", late: str | None = None) -> DataFrame:
    """Sessions of each key by event time; for a stream, ``late`` is its watermark."""
    if late:
        events = events.withWatermark("ts", late)
    return events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


SESSIONS = "kind string, start timestamp, end timestamp, n long"


def sessions_with_late(events: DataFrame, key: str, arrival: list[str], gap: int, delay: int) -> DataFrame:
    """``key``, kind, start, end, n: sessions of the events (ts) that came in time, and how many of each key came late.

    In the order of ``arrival`` an event is late if it lies more than ``delay`` seconds before the latest that its key has
    brought so far. A session ends ``gap`` seconds after its last event.
    """
    rows = with_running(laid_out(events.select(key, "ts", *arrival), [key], arrival), [key], highs={"_high": F.col("ts")})
    late = F.coalesce(F.unix_micros("ts") < F.unix_micros("_high") - delay * 1_000_000, F.lit(False))
    rows = stored(rows.withColumn("_late", late).drop("_part", "_at"))
    near = F.unix_micros("ts") - F.unix_micros("prev_ts") <= gap * 1_000_000
    on_time = chains(rows.filter("not _late"), [key], ["ts", *arrival], ["ts"], near).groupBy(key, "chain").agg(F.min("ts").alias("start"), F.max("ts").alias("_last"), F.count(F.lit(1)).alias("n"))
    end = F.timestamp_micros(F.unix_micros("_last") + gap * 1_000_000)
    none = F.lit(None).cast("timestamp")
    counts = rows.filter("_late").groupBy(key).agg(F.count(F.lit(1)).alias("n")).select(key, F.lit("LATE").alias("kind"), none.alias("start"), none.alias("end"), "n")
    return on_time.select(key, F.lit("SESSION").alias("kind"), "start", end.alias("end"), "n").unionByName(counts)


def run_sessions_with_late(stream: DataFrame, key: str, arrival: str, gap: int, delay: int, idle: str = "1 hour") -> DataFrame:
    """The stream twin of ``sessions_with_late``: state for each key, and rows as sessions close or events come late.

    A key keeps its latest event and its open sessions, which are few as those further back than gap and delay are
    closed. LATE rows add up. A timer closes the sessions of a key that brings nothing for ``idle``.
    """
    step_gap, step_delay, idle_ms = gap * 1_000_000, delay * 1_000_000, int(_seconds(idle) * 1000)

    def step(name, batches, state: GroupState):
        high, sessions = (state.get[0], [list(x) for x in zip(*state.get[1:], strict=True)]) if state.exists else (None, [])
        late, closed = 0, []
        if state.hasTimedOut:
            closed, sessions = sessions, []
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values([arrival, "t"])
            for t in rows["t"].tolist():
                if high is not None and t < high - step_delay:
                    late += 1
                    continue
                high = t if high is None else max(high, t)
                met = [s for s in sessions if s[0] - step_gap <= t <= s[1] + step_gap]
                sessions = [s for s in sessions if s not in met]
                sessions.append([min([t, *[s[0] for s in met]]), max([t, *[s[1] for s in met]]), 1 + sum(s[2] for s in met)])
            closed = [s for s in sessions if high is not None and s[1] + step_gap < high - step_delay]
            sessions = sorted(s for s in sessions if s not in closed)
            state.update((high, *([s[i] for s in sessions] for i in range(3))))
            state.setTimeoutDuration(idle_ms)
        out = [(name[0], "SESSION", pd.Timestamp(a, unit="us"), pd.Timestamp(b + step_gap, unit="us"), n) for a, b, n in closed]
        out += [(name[0], "LATE", pd.NaT, pd.NaT, late)] if late else []
        yield pd.DataFrame(out, columns=[key, "kind", "start", "end", "n"]).astype({"start": "datetime64[us]", "end": "datetime64[us]", "n": "int64"})

    rows = stream.select(key, F.unix_micros("ts").alias("t"), arrival)
    kept = "high long, first array<long>, last array<long>, n array<long>"
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {stream.schema[key].dataType.simpleString()}, {SESSIONS}", kept, "append", GroupStateTimeout.ProcessingTimeTimeout)


def _seconds(text: str) -> float:
    return pd.Timedelta(text).total_seconds()


def phase_progress(events: DataFrame, phases: list[str]) -> DataFrame:
    """Latest state of each phase of each job; phases not reached yet are queued."""
    last = events.groupBy("job", "phase").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"))
    grid = events.select("job").distinct().withColumn("phase", F.explode(F.array(*map(F.lit, phases))))
    return grid.join(last, ["job", "phase"], "left").withColumn("state", F.coalesce("state", F.lit("QUEUED")))


def last_known(history: DataFrame, key: str, order: list, fields: list[str]) -> DataFrame:
    """Each change with the state before and after it: every event sets one field, the others keep their last value."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy(*order)
    out = history
    for f in fields:
        out = out.withColumn(f"after_{f}", F.last(f, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn(f"before_{f}", F.last(f, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    return out
