"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but blank, tab, LF, VT, FF and CR.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text in order; an empty array for a text without any."""
    return F.array_remove(F.split(text, SPACE), "")


def count_of(text: Column, chars: str) -> Column:
    """How many code points of the text are among ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for the third of the documents that no model may learn from."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def hash_share(*columns: Column) -> Column:
    """A uniform number in [0, 1) that depends on the values only."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(2**53))
