"""Sinks: CSV export (S4). The published star-schema mart (S8) is in ``sources.mart``."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", quote_all: bool = False) -> None:
    """Header CSV, one directory of part files (what ``to_csv(index=False)`` produced); quotes
    are doubled and blanks kept, so that ``read_csv_table`` gives the rows back."""
    (df.write.mode(mode).option("header", True).option("encoding", "UTF-8").option("escape", '"').option("quoteAll", quote_all)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path))
