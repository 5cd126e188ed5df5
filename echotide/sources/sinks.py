"""Tables to files for publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_safe(value: Column) -> Column:
    """Null for what JSON has no number for."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def take_tsv(rows: DataFrame, path: str, low: Column, high: Column, total: Column) -> None:
    """Per second: time, level, centroid and the shares of low and high bands, tab-separated, parted by take."""
    share = lambda x: F.round(x / (total + 1e-20), 4)
    out = rows.select(
        "take",
        F.col("t").alias("Time"),
        F.round("level_db", 1).alias("level_dbfs"),
        F.round("centroid", 0).alias("centroid"),
        share(low).alias("low_frac"),
        share(high).alias("high_frac"),
    )
    out.write.partitionBy("take").csv(path, sep="\t", header=True)


def csv_table(wide: DataFrame, path: str) -> None:
    """One row for each session, blanks for nulls; a catalogue is small, so it is one file."""
    wide.coalesce(1).write.csv(path, header=True, nullValue="")


def markdown(rows: DataFrame, most: int = 10_000) -> str:
    """A table of at most ``most`` rows as Markdown; more are an error."""
    held = rows.limit(most + 1).collect()
    if len(held) > most:
        raise ValueError("too many rows for a document")
    cell = lambda v: "" if v is None else f"{v:g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in held)])
