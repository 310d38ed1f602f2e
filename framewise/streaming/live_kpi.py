"""Live KPIs over a stream (Structured Streaming).

Rows arrive as files (or any streaming source); ``live_kpi`` declares a
watermarked, windowed aggregate (tumbling, sliding or session windows);
``run_live_kpi`` drives it with ``foreachBatch`` in *update* mode and puts
every batch's changed windows in place of their earlier values in a table
under the shared checkpoint folder, which so holds each window once. ``availableNow`` processes what is there and stops; any other
trigger keeps the query running.

Semantics kept from Spark: a watermark needs a TIMESTAMP (local time) column,
so ``timestamp_ntz`` input is cast first; rows later than the watermark are
dropped in update/append mode only, and only from the batch after the one
that moved the watermark.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.session import cut_lineage, ensure_checkpoint_dir


def live_kpi(stream: DataFrame, time: str, value: str, window: str = "1 hour",
             watermark: str = "10 minutes", keys: Sequence[str] = (), kind: str = "tumbling",
             slide: str | None = None, gap: str | None = None) -> DataFrame:
    """Windowed average / maximum / minimum / count of ``value``."""
    t = F.col(f"`{time}`")
    if isinstance(stream.schema[time].dataType, T.TimestampNTZType):
        stream = stream.withColumn(time, t.cast("timestamp"))
    s = stream.withWatermark(time, watermark)
    if kind == "tumbling":
        w = F.window(F.col(time), window)
    elif kind == "sliding":
        w = F.window(F.col(time), window, slide or window)
    elif kind == "session":
        w = F.session_window(F.col(time), gap or window)
    else:
        raise ValueError(f"unknown window kind {kind!r}")
    v = F.col(f"`{value}`").cast("double")
    return (s.groupBy(w.alias("w"), *[F.col(f"`{k}`") for k in keys])
            .agg(F.avg(v).alias("avg_value"), F.max(v).alias("max_value"), F.min(v).alias("min_value"),
                 F.count(F.lit(1)).alias("events"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                    *[F.col(f"`{k}`") for k in keys], "avg_value", "max_value", "min_value", "events"))


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet",
                glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.load(path)


MEASURES = ("avg_value", "max_value", "min_value", "events")


def run_live_kpi(agg: DataFrame, out_path: str | None = None, trigger_once: bool = True, mode: str = "update",
                 state_path: str | None = None) -> tuple[str, object]:
    """Start the aggregate; every micro-batch's windows replace their earlier values in a table under ``out_path`` that holds
    each window once. ``mode="update"`` emits changed windows each batch; session windows need ``mode="append"``, which emits
    a window once the watermark has closed it. When a finite append stream (``trigger_once``) ends, the windows still open are
    read from its state and written as one closing batch, so no window is missing. With the same ``out_path`` and
    ``state_path`` a later run goes on where an earlier one stopped. Returns the output path and the streaming query (already
    finished when ``trigger_once``)."""
    spark = agg.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    run = uuid.uuid4().hex
    out_path = out_path or f"{base}/live_kpi-{run}/out"
    ckpt = state_path or f"{base}/live_kpi-{run}/state"
    batches: list[int] = []
    # an empty file says what the columns are, also when there is no batch at all
    spark.createDataFrame([], agg.schema).withColumn("batch_id", F.lit(0).cast("long")).write.mode("append").parquet(
        f"{out_path}/{DAY}=1970-01-01")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batches.append(batch_id)
        upsert_windows(batch, out_path, batch_id)

    w = agg.writeStream.outputMode(mode).option("checkpointLocation", ckpt).foreachBatch(sink)
    q = w.trigger(availableNow=True).start() if trigger_once else w.start()
    if trigger_once:
        q.awaitTermination()
        if mode == "append" and batches:
            sink(_open_windows(agg, ckpt), max(batches) + 1)
    return out_path, q


DAY = "window_day"


def upsert_windows(batch: DataFrame, out_path: str, batch_id: int) -> None:
    """Put a batch's windows into the table at ``out_path``, in place of their earlier values.

    The table is partitioned by the day a window starts on. Only days that the batch touches are read and written again
    (dynamic partition overwrite), so the table's size is the number of windows, whatever the number of batches. A batch that is
    run again after a failure replaces windows by the same values."""
    new = cut_lineage(batch.withColumns({"batch_id": F.lit(batch_id).cast("long"), DAY: F.to_date("window_start")}))
    days = [r[0] for r in new.select(DAY).distinct().collect()]
    if not days:
        return
    old = _table(new.sparkSession, out_path).where(F.col(DAY).isin(days))
    key = [c for c in batch.columns if c not in MEASURES]
    again = [old[c].eqNullSafe(new[c]) for c in key]
    merged = cut_lineage(old.join(new, again, "left_anti").unionByName(new))
    merged.repartition(DAY).write.partitionBy(DAY).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(out_path)


def _table(spark: SparkSession, out_path: str) -> DataFrame:
    schema = spark.read.parquet(f"{out_path}/{DAY}=1970-01-01").schema
    return spark.read.schema(T.StructType(schema.fields + [T.StructField(DAY, T.DateType())])).parquet(out_path)


def _open_windows(agg: DataFrame, ckpt: str) -> DataFrame:
    """The windows of a finished :func:`live_kpi` stream that its watermark has
    not closed, from its state: the window and the keys (in the state's key, or
    for sessions in its value), then the five buffers of the aggregates."""
    state = agg.sparkSession.read.format("statestore").load(ckpt)
    parts = []
    for part in ("key", "value"):
        fields = state.schema[part].dataType.fields
        named = T.StructType([T.StructField(f"{part}{i}", f.dataType) for i, f in enumerate(fields)])
        state = state.withColumn(part, F.col(part).cast(named))  # by position: two buffers are named "count"
        parts.append([F.col(f"{part}.{n}") for n in named.names])
    cells = parts[1] if len(parts[1]) > 5 else parts[0] + parts[1]
    w, keys, (total, n, high, low, events) = cells[0], cells[1:-5], cells[-5:]
    out = [w["start"].cast("timestamp_ntz"), w["end"].cast("timestamp_ntz"), *keys,
           F.try_divide(total, n), high, low, events]
    return state.select(*[c.alias(f.name) for c, f in zip(out, agg.schema.fields, strict=True)])


def latest_windows(spark: SparkSession, out_path: str, keys: Sequence[str] = ()) -> DataFrame:
    """The windows written by :func:`run_live_kpi`, each with its newest values; none if the stream had no rows."""
    return _table(spark, out_path).drop("batch_id", DAY)
