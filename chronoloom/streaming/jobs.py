"""Job feeds, debounced saves and protected upserts in Structured Streaming.

Every operator has a batch twin over the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..core.quantiles import attach
from ..core.timeline import Timeline, carried, islands
from ..functions.text import stable_id
from ..operators.merge import latest, reanalysis_merge
from ..operators.projections import clip

TERMINAL = ("completed", "failed")
ACTIVE = ("queued", "processing")


# --------------------------------------------------------------------------
# change feed


def job_changes_batch(rows: DataFrame, tl: Timeline, payload: str, status: str) -> DataFrame:
    """Rows whose payload differs from the row before, up to the first terminal one."""
    order = F.struct(*tl.order)
    ends = rows.filter(F.col(status).isin(*TERMINAL)).groupBy(*tl.keys).agg(F.min(order).alias("_end"))
    open_rows = attach(rows, ends, tl.keys).filter(F.col("_end").isNull() | (order <= F.col("_end")))
    before = carried(open_rows.drop("_end"), tl, prev={"_prev": F.col(payload)})
    return before.filter(F.col("_prev").isNull() | (F.col("_prev") != F.col(payload))).drop("_prev")


def job_changes(stream: DataFrame, key: str, ts: str, order: Sequence[str], payload: str, status: str,
                late: str, forget_after_ms: int = 86_400_000) -> DataFrame:
    """Streaming change feed: emit a row only when its payload is new for the job.

    The state of a job is its last payload and whether it has ended; it is
    dropped once the watermark is ``forget_after_ms`` past the job's last row.
    """
    schema = stream.schema
    names = stream.columns

    def feed(job, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, ended, seen = state.get if state.exists else ("", False, 0)
        rows = pd.concat(list(batches), ignore_index=True).sort_values(list(order), kind="stable")
        seen = max(seen, int(rows[ts].astype("datetime64[ms]").astype("int64").max()))
        keep = []
        for i, (text, phase) in enumerate(zip(rows[payload], rows[status], strict=True)):
            if ended:
                break
            if text != last:
                keep.append(i)
                last = text
            ended = phase in TERMINAL
        state.update((last, ended, seen))
        state.setTimeoutTimestamp(max(seen + forget_after_ms, state.getCurrentWatermarkMs() + 1))
        yield rows.iloc[keep][names]

    return stream.withWatermark(ts, late).groupBy(key).applyInPandasWithState(
        feed, schema, "last string, ended boolean, seen bigint", "append", GroupStateTimeout.EventTimeTimeout
    )


# --------------------------------------------------------------------------
# progress


def job_progress(stream: DataFrame, key: str, amount: Column) -> DataFrame:
    """Highest progress seen per job, in [.01, .97]; update mode."""
    return stream.groupBy(key).agg(F.max(clip(amount, 0.01, 0.97)).alias("progress"))


# --------------------------------------------------------------------------
# debounced save


def debounce(stream: DataFrame, key: str, ts: str, state: str, gap: str, late: str) -> DataFrame:
    """Last state of every burst that a quiet period of ``gap`` ends; append mode.

    A burst comes out once the watermark has passed its end; rows later than
    ``late`` are dropped.
    """
    bursts = stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w"))
    return bursts.agg(F.max_by(state, ts).alias(state), F.max(ts).alias("saved_at"), F.count("*").alias("changes")).select(
        key, F.col("w.start").alias("started_at"), "saved_at", state, "changes"
    )


def debounce_batch(rows: DataFrame, tl: Timeline, state: str, gap: int) -> DataFrame:
    """Batch twin on integer positions; one busy key is spread over time slices."""
    bursts = islands(rows, tl, gap, "started_at")
    order = F.struct(*tl.order)
    return bursts.groupBy(*tl.keys, "started_at").agg(
        F.max_by(state, order).alias(state), F.max(tl.pos).alias("saved_at"), F.count("*").alias("changes")
    )


# --------------------------------------------------------------------------
# protected upsert of arriving rows


def merge_batch(current: DataFrame, arriving: DataFrame, tl: Timeline, radius: int, version: int) -> DataFrame:
    """New version of the touched tracks: protected rows stay, arriving ones fill in.

    Ids are derived from track, position and lane, so a repeated batch gives the
    same rows.  A track left without rows keeps a marker row without id.
    """
    touched = arriving.select(*tl.keys).distinct()
    old = current.join(touched, list(tl.keys), "left_semi").drop("version")
    key = F.concat_ws(":", F.lit("stream-hit"), *[F.col(k).cast("string") for k in tl.keys], F.col(tl.pos).cast("string"), "source")
    fresh = arriving.withColumn("id", stable_id(key)).dropDuplicates(["id"])
    merged = reanalysis_merge(old, fresh, tl, radius).drop("origin")
    marker = touched.select(*tl.keys)
    return merged.unionByName(marker, allowMissingColumns=True).withColumn("version", F.lit(version))


BUCKET, SLOT = "bucket", "slot"


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def bucketed_state(spark: SparkSession, path: str, columns: str, touched: Sequence[int] | None = None, before: int | None = None) -> DataFrame:
    """Rows of the newest version of each bucket (of ``touched`` alone), of versions up to ``before``; no row if there is none.

    A bucket has two slots with its whole state of two versions; other buckets' files are not opened.
    """
    schema = f"id string, {columns}, version bigint, {BUCKET} int, {SLOT} int"
    try:
        known = spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    if touched is not None:
        known = known.filter(F.col(BUCKET).isin(list(touched)))
    if before is not None:
        known = known.filter(F.col("version") < before)
    newest = known.groupBy(BUCKET).agg(F.max("version").alias("version"))
    return known.join(F.broadcast(newest), [BUCKET, "version"], "left_semi")  # a row per bucket


def merge_into(batch: DataFrame, batch_id: int, path: str, tl: Timeline, radius: int, buckets: int = 64) -> None:
    """Writes the buckets that a micro-batch touches, each as a whole, into the slot that does not hold its state so far.

    A repeated batch finds the state before it in the other slot, whatever an earlier attempt has left,
    so it gives the same rows; ``buckets`` must stay the same for a table.
    """
    spark = batch.sparkSession
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema.fields if f.name not in ("id", "version"))
    placed = batch.withColumn(BUCKET, bucket_of(tl.keys, buckets))
    touched = [r[0] for r in placed.select(BUCKET).distinct().collect()]  # at most ``buckets``
    if not touched:
        return
    state = bucketed_state(spark, path, columns, touched, batch_id)
    held = dict(state.select(BUCKET, SLOT).distinct().collect())
    current = state.drop(BUCKET, SLOT)
    merged = merge_batch(current.filter("id is not null"), batch, tl, radius, batch_id)
    arrived = batch.select(*(F.col(k).alias(f"_a_{k}") for k in tl.keys)).distinct()
    others = current.join(arrived, [F.col(k).eqNullSafe(F.col(f"_a_{k}")) for k in tl.keys], "left_anti")
    others = others.withColumn("version", F.lit(batch_id).cast("bigint"))
    rows = merged.withColumn("version", F.col("version").cast("bigint")).unionByName(others, allowMissingColumns=True)
    slots = F.array(*(F.lit(1 - held.get(b, 1)) for b in range(buckets)))
    rows = rows.withColumn(BUCKET, bucket_of(tl.keys, buckets)).withColumn(SLOT, F.get(slots, F.col(BUCKET)))
    writer = rows.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(BUCKET, SLOT).parquet(path)


def stored_rows(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Current rows of a table that ``stream_merge`` keeps; ``columns`` is DDL without id and version."""
    return bucketed_state(spark, path, columns).filter("id is not null").drop(BUCKET, SLOT)


def stream_merge(stream: DataFrame, path: str, checkpoint: str, tl: Timeline, radius: int, buckets: int = 64):
    """Start the upsert: every micro-batch replaces the buckets of its tracks under ``path`` (see ``merge_into``).

    A micro-batch reads and writes the buckets it touches; the table never holds more than two states of a bucket.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        merge_into(batch, batch_id, path, tl, radius, buckets)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


# --------------------------------------------------------------------------
# interrupted jobs


def sweep(rows: DataFrame, key: str, order: Sequence[str], seen: str, now: Column, timeout, code: str) -> DataFrame:
    """Latest row per job; queued or processing jobs without a sign of life fail."""
    newest = latest(rows, [key], order)
    dead = F.col("status").isin(*ACTIVE) & (F.col(seen) < now - timeout)
    return newest.withColumns(
        {"error_code": F.when(dead, code), "status": F.when(dead, "failed").otherwise(F.col("status"))}
    )


def sweep_stream(stream: DataFrame, key: str, ts: str, late: str, timeout_ms: int, code: str) -> DataFrame:
    """Emit a failed row for every job that stays active without news for ``timeout_ms``.

    Event-time timers: a job is given up once the watermark passes its last sign
    of life plus the timeout.
    """

    def watch(job, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [job[0]], "status": ["failed"], "error_code": [code]})
            return
        last = state.get[0] if state.exists else -1
        phase = state.get[1] if state.exists else ""
        for pdf in batches:
            at = pdf[ts].astype("datetime64[ms]").astype("int64")
            i = int(at.argmax())
            if int(at.iloc[i]) >= last:
                last, phase = int(at.iloc[i]), str(pdf["status"].iloc[i])
        if phase in ACTIVE:
            state.update((last, phase))
            state.setTimeoutTimestamp(max(last + timeout_ms, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    kind = dict(stream.dtypes)[key]
    return stream.withWatermark(ts, late).groupBy(key).applyInPandasWithState(
        watch, f"`{key}` {kind}, status string, error_code string", "last bigint, phase string", "append",
        GroupStateTimeout.EventTimeTimeout,
    )
