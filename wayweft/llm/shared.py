"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The class of a word's characters in Java and SQL patterns; all white space is ASCII.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_words(text: Column) -> Column:
    """The words of a text as an array; no words for a null or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


MASK_BITS = 23


def mask_rows(df: DataFrame, key: str, bits: int = MASK_BITS) -> DataFrame:
    """(w, b): the 64-bit words of a bit map of fixed size with the low bits of a BIGINT column set; 2^bits / 64 rows at most."""
    return (
        df.where(F.col(key).isNotNull())
        .selectExpr(f"{key} & {(1 << bits) - 1}L AS low")
        .selectExpr("low >> 6 AS w", "1L << CAST(low & 63 AS INT) AS b")
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
    )


def mask_of(df: DataFrame, key: str, bits: int = MASK_BITS) -> np.ndarray:
    """A bit map of fixed size with the low bits of a BIGINT column set.

    It bounds what a later scan has to send on: whatever it lets through is matched exactly
    afterwards, so a crowded map costs time and no rows. At most 2^bits bits reach the driver.
    """
    mask = np.zeros((1 << bits) // 64, np.uint64)
    found = mask_rows(df, key, bits).toArrow()
    if found.num_rows:
        mask[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return mask


def in_mask(mask: np.ndarray, keys: np.ndarray) -> np.ndarray:
    low = keys.astype(np.uint64) & np.uint64(len(mask) * 64 - 1)
    return (mask[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) == 1


def carry(docs: DataFrame, *named: str, new: tuple[str, ...] = ()) -> DataFrame:
    """The ``named`` columns and all but the text in one struct, so no column of ``docs`` meets a working name.

    Columns that ``new`` names, in any case, are left behind.
    """
    rest = [c for c in docs.columns if c != "text" and c.lower() not in new]
    return docs.select(*named, F.struct(*[F.col(f"`{c}`") for c in rest]).alias("others"))


def uncarried(out: DataFrame, docs: DataFrame, new: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``docs`` in their order, texts as they are now, and the ``new`` ones."""
    old = [c for c in docs.columns if c.lower() not in new]
    return out.select(*[F.col("text") if c == "text" else F.col("others").getField(c).alias(c) for c in old], *new)
