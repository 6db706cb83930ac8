"""Large CSV files whose quoted fields hold line breaks, read by many tasks (S2).

Spark's multi-line CSV reader takes one task per file. Here a file is read as plain lines
by byte ranges, and the number of quotes before a line tells whether it starts a record:
after an even number it does, after an odd one it continues a quoted field (an escaped quote
is two quotes and changes nothing). The parity at the start of a range is that of all
quotes in the ranges before it, so

1. one pass counts the quotes of each range and keeps its ends: the lines before the first
   possible record start and those after the last, for either parity;
2. the ranges' parities are summed along each file, a row for each range;
3. a second pass emits the records that lie inside a range; those that cross ranges are put
   together from the ends of step 1;
4. Spark's own CSV parser (``from_csv``) turns records into typed rows. As in the multi-line
   reader the first line of a file tells its line end: with CR LF there, those in fields become LF.

Quoting must be that of RFC 4180: a field with a quote in it is quoted. A range that lies
inside one long field is carried as a whole to the record it belongs to. Empty lines between
records are skipped, the first record of a file is its header. Only a row for each byte
range (its parity) goes through the driver and to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LINES = "value string, file string, block long"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    # only "\\n" ends a line, so that a carriage return stays where it was
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, list[str]]]:
    """Lines of each byte range, in order; a task reads one range after the other."""
    for batch in batches:
        start = 0
        files, blocks, values = batch["file"].tolist(), batch["block"].tolist(), batch["value"].tolist()
        for i in range(1, len(values) + 1):
            if i == len(values) or files[i] != files[start] or blocks[i] != blocks[start]:
                yield files[start], blocks[start], values[start:i]
                start = i


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(file, block, odd, starts_even, starts_odd, head, tail_even, tail_odd) of each byte range: the parity of
    its quotes, the record starts in it and its ends for either parity at its own start."""
    at, state, crlf = None, None, False

    def row():
        odd, starts, head, tails = state
        return pd.DataFrame([(at[0], at[1], odd, *starts, "\n".join(head), "\n".join(tails[0]), "\n".join(tails[1]), crlf)],
                            columns=["file", "block", "odd", "starts_even", "starts_odd", "head", "tail_even", "tail_odd", "crlf"])

    for file, block, lines in _runs(batches):
        if at != (file, block):
            if at is not None:
                yield row()
            at, state, crlf = (file, block), [0, [0, 0], [], ([], [])], lines[0].endswith("\r")
        for line in lines:
            for p in (0, 1):                       # parity at the start of the range
                if state[0] ^ p == 0:              # the line starts a record
                    state[3][p].clear()
                    state[1][p] += 1
                if p == 0 or state[1][1]:
                    state[3][p].append(line)
                else:
                    state[2].append(line)          # still the field of a range before
            state[0] ^= line.count('"') & 1
    if at is not None:
        yield row()


def _inside(known: dict[tuple[str, int], tuple[int, bool]]):
    """Records that start and end in one byte range; ``known`` is the parity at its start and the file's line end."""
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, odd, crlf, record, first = None, 0, False, None, False
        for file, block, lines in _runs(batches):
            if at != (file, block):
                at, (odd, crlf), record, first = (file, block), known[file, block], None, block == 0
            out = []
            for line in lines:
                if not odd:
                    record = []
                odd ^= line.count('"') & 1
                if record is not None:
                    record.append(line)
                if not odd and record is not None:
                    text, record = "\n".join(record), None
                    if first and text.strip("\r"):
                        first = False              # the header
                    elif text.strip("\r"):
                        out.append((text.removesuffix("\r"), crlf))
            yield pd.DataFrame(out, columns=["record", "crlf"])
    return emit


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record, crlf): whole CSV records of the file or folder ``path``, headers left out, read by byte
    ranges, and whether their file's lines end in CR LF."""
    import uuid

    from ..session import shared_dir
    ends_path = shared_dir(spark, f"multiline/{uuid.uuid4().hex}")
    (_lines(spark, path).mapInPandas(_ends, "file string, block long, odd int, starts_even long, starts_odd long, head string, tail_even string, tail_odd string, crlf boolean")
     .write.parquet(ends_path))
    ends = spark.read.parquet(ends_path)
    along = Window.partitionBy("file").orderBy("block")
    before = F.coalesce(F.sum("odd").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    known = ends.withColumn("start", before.cast("int")).withColumn("crlf", F.first("crlf").over(along))
    of_range = {(r["file"], r["block"]): (r["start"], r["crlf"])  # a row for each byte range
                for r in known.select("file", "block", "start", "crlf").collect()}
    whole = _lines(spark, path).mapInPandas(_inside(of_range), "record string, crlf boolean")
    # records that cross ranges: the open tail of one, then heads up to and with that of the next range that starts a record
    starts = (F.col("start") == 0) | (F.col("starts_odd") > 0)
    parts = known.withColumn("starts", starts).withColumn("owner", F.sum(starts.cast("int")).over(along))
    tails = parts.where(F.col("starts") & ((F.col("start") + F.col("odd")) % 2 == 1)).select(
        "file", "owner", "block", F.when(F.col("start") == 0, F.col("tail_even")).otherwise(F.col("tail_odd")).alias("text"),
        ((F.col("block") == 0) & (F.col("starts_even") == 1)).alias("header"), "crlf")
    heads = parts.where("start = 1").select(
        "file", (F.col("owner") - F.col("starts").cast("int")).alias("owner"), "block", F.col("head").alias("text"),
        F.lit(False).alias("header"), "crlf")
    text = F.rtrim(F.array_join(F.col("x.text"), "\n"), F.lit("\r"))
    crossing = (tails.unionByName(heads).groupBy("file", "owner", "crlf")
                .agg(F.sort_array(F.collect_list(F.struct("block", "text"))).alias("x"), F.max("header").alias("header"))
                .where("NOT header").select(text.alias("record"), "crlf"))
    return whole.unionByName(crossing)


def read_records(spark: SparkSession, path: str, schema: T.StructType, corrupt: str = "_corrupt") -> DataFrame:
    """Typed rows of a multi-line CSV file or folder, with malformed records in ``corrupt``."""
    full = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType(), True)])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt, "quote": '"', "escape": '"',
               "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss", "multiLine": "true"}
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in full)
    text = F.when(F.col("crlf"), F.replace("record", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("record"))
    parsed = records(spark, path).select("record", F.from_csv(text, ddl, options).alias("r"))
    return parsed.select(*[F.col(f"r.`{f.name}`") for f in schema], F.when(F.col(f"r.`{corrupt}`").isNotNull(), F.col("record")).alias(corrupt))
