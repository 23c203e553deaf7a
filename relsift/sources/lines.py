"""Line files and quoted CSV read in splits, with the order of the file kept.

Spark's text source cuts a file into splits at line ends; ``_metadata`` tells each line's
file and split. Lines are numbered inside their split as they stream by, one row per split
is aggregated (lines, quotes), and prefix sums over the splits of a file give each split
what lies before it: line numbers, or whether it starts inside quotes. No file is ever one
task, and only the per-split table is ordered.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import materialize


def split_lines(spark: SparkSession, path) -> DataFrame:
    """``(file, split, value)``: lines by ``\\n`` with the start of their split."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def _splits(lines: DataFrame) -> DataFrame:
    """``(file, split, n, quotes)``: one row per split."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"')))
    return materialize(lines.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"), F.sum(quotes).alias("quotes")))


def read_numbered_lines(spark: SparkSession, path, out: str = "text", first: int = 1) -> DataFrame:
    """``(id, out)``: every line of the files at ``path``, numbered from ``first`` through
    all files in order of their names. A carriage return at a line's end is not part of
    it. Empty lines count; a line feed at the end of a file starts no line."""
    lines = split_lines(spark, path)
    order = Window.partitionBy(F.lit(0)).orderBy("file", "split")  # one row per split
    starts = _splits(lines).select("file", "split", (F.sum("n").over(order) - F.col("n")).alias("_before"))

    def number(batches):
        at, n = None, 0
        for batch in batches:
            place = list(zip(batch.column("file").to_pylist(), batch.column("split").to_pylist()))
            numbers = []
            for p in place:
                at, n = (at, n + 1) if p == at else (p, 0)
                numbers.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], ["file", "split", "value", "_n"])

    numbered = lines.mapInArrow(number, "file string, split long, value string, _n long")
    return numbered.join(starts, ["file", "split"]).select(
        (F.col("_before") + F.col("_n") + first).alias("id"), F.regexp_replace("value", "\r$", "").alias(out))


def read_csv_splits(spark: SparkSession, path, schema: StructType | str, header: bool = True) -> DataFrame:
    """Comma separated, double-quoted CSV with line breaks inside quotes, read in splits.

    A quote inside a quoted field is doubled, and fields with quotes are quoted, so a line
    starts a record exactly if an even number of quotes lies before it. Splits emit the
    records that they hold whole; a split's last record and the lines before its first go
    to one aggregate per split, which puts records that cross splits together, however
    many they cross. ``header``: the first record of each file is left out. Line breaks inside
    quotes stay as they are, ``\\r\\n`` too; empty lines outside quotes are no records."""
    lines = split_lines(spark, path)
    splits = _splits(lines)
    order = Window.partitionBy("file").orderBy("split")
    quoted = splits.select("file", "split", F.pmod(F.sum("quotes").over(order) - F.col("quotes"), F.lit(2)).cast("int").alias("inside"),
                           (F.row_number().over(order) == 1).alias("opens"))

    def cut(batches):
        place, inside, held, is_head, skip = None, 0, [], False, False

        def record(rows, kind):
            rows.append((place[0], place[1], kind, "\n".join(held)))

        for batch in batches:
            rows = []
            for file, split, value, start, opens in zip(*[batch.column(c).to_pylist() for c in ("file", "split", "value", "inside", "opens")]):
                if (file, split) != place:
                    if place is not None and held and not skip:
                        record(rows, 0 if is_head else 2)
                    elif place is not None and skip:
                        rows.append((place[0], place[1], 3, "\n".join(held)))
                    place, inside, held, is_head, skip = (file, split), start, [], bool(start), opens and header
                if inside % 2 == 0 and held:  # a record starts: what is held is whole
                    if is_head:
                        record(rows, 0)
                    elif not skip:
                        record(rows, 1)
                    held, is_head, skip = [], False, False
                held.append(value)
                inside += value.count('"')
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int32(), pa.string()))], ["file", "split", "kind", "value"])
        if held:
            rows = [(place[0], place[1], 3 if skip else 0 if is_head else 2, "\n".join(held))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int32(), pa.string()))], ["file", "split", "kind", "value"])

    parts = materialize(lines.join(F.broadcast(quoted) if splits.count() <= 100_000 else quoted, ["file", "split"]).select(
        "file", "split", "value", "inside", "opens").mapInArrow(cut, "file string, split long, kind int, value string"))
    # kinds: 0 lines before the first record, 1 a whole record, 2 the last record, 3 a header that is the last
    pieces = parts.where("kind <> 1")
    opened = F.last(F.when(F.col("kind") >= 2, F.col("split")), ignorenulls=True).over(Window.partitionBy("file").orderBy("split", "kind"))
    crossing = (pieces.withColumn("_from", opened).groupBy("file", "_from").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "kind", "value"))), lambda x: x.value), "\n").alias("value"),
        F.max("kind").alias("kind")).where("kind <> 3").select("value"))
    records = parts.where("kind = 1").select("value").unionByName(crossing)
    record = F.regexp_replace("value", "\r$", "")
    fields = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return (records.select(record.alias("value")).where("value <> ''")
            .select(F.from_csv("value", fields, {"quote": '"', "escape": '"', "sep": ","}).alias("r")).select("r.*"))
