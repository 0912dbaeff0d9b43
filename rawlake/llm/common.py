"""Words, row keys and staged tables shared by the operators here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rawlake.session import work_folder

# White space of the contracts: a blank and the bytes 9 to 13.
SPACE = " \t\n\u000b\f\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def stage(df: DataFrame, *partition_by: str, compression: str = "snappy") -> DataFrame:
    """The rows as a written table in the shared folder, read again.

    Cuts the lineage: a lost executor costs a re-read, not the work before it.
    """
    path = work_folder(df.sparkSession)
    writer = df.write.option("compression", compression)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """The text, where null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Maximal runs of characters that are not white space."""
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS + "+"))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; all other characters as they are."""
    return F.translate(text, UPPER, UPPER.lower())


def hash_pair(*columns: Column) -> list[Column]:
    """Two independent 64-bit hashes, as one 128-bit identity of the values."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit(7), *columns)]
