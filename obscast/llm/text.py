"""Small column helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, the only separator that the word contracts know.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else untouched."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Array of the maximal runs without ASCII white space; null text gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def shingles(tokens: Column, width: int) -> Column:
    """64-bit hashes of the windows of `width` words, in order, repeats kept.

    With fewer words the whole sequence is one shingle; without words there is none.
    """
    n = F.size(tokens)
    hashed = F.transform(
        tokens, lambda w, i: F.xxhash64(w, *[F.get(tokens, i + k) for k in range(1, width)])
    )
    return F.slice(hashed, 1, F.least(n, F.greatest(F.lit(1), n - (width - 1))))


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
