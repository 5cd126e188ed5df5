"""Continuous levels: windows with watermarks, day roll-ups, and states that carry over batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.scalars import db, power


def window_levels(stream: DataFrame, keys: list[str], ts: str = "ts", x: str = "level_db", window: str = "60 seconds", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Energy mean, peak and rows of tumbling or hopping windows; rows later than ``late`` are left out."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    frame = F.window("_ts", window, slide) if slide else F.window("_ts", window)
    found = timed.groupBy(*keys, frame.alias("w")).agg(
        db(F.avg(power(F.col(x)))).alias("leq_db"), F.max(x).alias("peak_db"), F.count("*").alias("rows")
    )
    return found.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "leq_db", "peak_db", "rows")


def session_windows(stream: DataFrame, keys: list[str], ts: str = "ts", gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Stretches of rows without a gap: start, end, rows."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    found = timed.groupBy(*keys, F.session_window("_ts", gap).alias("w")).agg(F.count("*").alias("rows"))
    return found.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows")


def switches(stream: DataFrame, key: str, t: str, x: str, threshold: float, hysteresis: float = 1.0) -> DataFrame:
    """(key, t, state) whenever a series crosses the threshold by half the hysteresis; the state outlives batches."""
    kind = stream.schema[key].dataType.simpleString()

    def run(name, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        on = bool(state.get[0]) if state.exists else None
        out = []
        rows = pd.concat(batches).sort_values(t)
        for at, v in zip(rows[t], rows[x], strict=True):
            now = False if v < threshold - hysteresis / 2 else True if v > threshold + hysteresis / 2 else (v > threshold if on is None else on)
            if now != on:
                out.append((name[0], at, "on" if now else "off"))
            on = now
        if on is not None:
            state.update((on,))
        yield pd.DataFrame(out, columns=[key, t, "state"])

    return stream.select(key, t, x).groupBy(key).applyInPandasWithState(
        run, f"`{key}` {kind}, `{t}` double, state string", "on boolean", "append", "NoTimeout"
    )


def roll_up_days(stream: DataFrame, table: str, checkpoint: str, summarise, day: str = "day") -> StreamingQuery:
    """Appends each batch to ``table``/rows and writes anew the summaries of the days that it touches.

    Rows are parted by day and then by batch: only the days of a batch are read again, and a batch that is replayed
    replaces what it wrote, so days are right after a restart.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        parted = batch.withColumn("batch", F.lit(number)).withColumn("_day", F.col(day).cast("string"))
        parted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_day", "batch").parquet(f"{table}/rows")
        days = [r["_day"] for r in parted.select("_day").distinct().collect()]  # a batch is of a few days
        if not days:
            return
        rows = spark.read.parquet(f"{table}/rows").where(F.col("_day").cast("string").isin(days)).drop("batch", "_day")
        out = summarise(rows).repartition(day)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(f"{table}/days")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def capture(spark: SparkSession, inbox: str, out: str, checkpoint: str, *, block_s: float = 60.0, files: int = 16, keep_audio: bool = True, matrix=None, log=None) -> StreamingQuery:
    """Feature tables of recordings as they come into a folder, parted by recording; ends when the folder is empty.

    A recording that can't be read is told to ``log`` and left out.  One that is there already is left out as well, so a
    batch that is replayed changes nothing.  Without ``keep_audio`` a recording is deleted once its features are there.
    ``matrix`` turns the channels of capsules into those of a field.
    """
    from ..operators import features
    from ..sources import sessions, wav

    wav.register(spark)
    names = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.wav").load(inbox).select("path")

    def step(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.collect()]  # at most ``files`` names
        good = [r["path"] for r in wav.takes(spark, paths, skip_bad=True).select("path").collect()] if paths else []
        for bad in sorted(set(paths) - set(good)):
            (log or print)(f"{bad} can't be read")
        if not good:
            return
        blocks = spark.read.format("wav").options(block_s=block_s, lead_s=0.5).load(",".join(good))
        if matrix is not None:
            turn = sessions.b_format

            @F.arrow_udf("array<float>")
            def field(samples: pa.Array) -> pa.Array:
                made = [turn(np.asarray(s, np.float32).reshape(-1, len(matrix)), matrix).astype(np.float32).ravel() for s in samples.to_pylist()]
                return pa.array(made, pa.list_(pa.float32()))

            blocks = blocks.withColumn("samples", field("samples"))
        features.write(blocks, out)
        if not keep_audio:
            for path in good:
                files_, where = sessions._files(path)
                files_.delete_file(where)

    return names.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
