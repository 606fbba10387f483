"""A cache of pages as compressed blobs by key, and the ways to read a page through it."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from marram.operators.relational import exclude

#: Fixed value: the encoding of stored text; characters that it lacks are stored as question marks.
ENCODING = "windows-1251"
CACHE_ONLY, FRESH_ONLY, CACHE_OR_FRESH = "cache only", "fresh only", "cache or fresh"


def packed(text: Column, compress: bool = True) -> Column:
    """Text as stored: encoded and, with ``compress``, gzipped; null stays null."""

    @F.pandas_udf(BinaryType())
    def stored(x: pd.Series) -> pd.Series:
        return x.map(lambda v: gzip.compress(v.encode(ENCODING, "replace"), mtime=0) if compress else v.encode(ENCODING, "replace"), na_action="ignore")

    return stored(text)


def unpacked(data: Column, is_compressed: Column) -> Column:
    """Stored bytes as text."""

    @F.pandas_udf(StringType())
    def opened(x: pd.Series, zipped: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else (gzip.decompress(v) if z else v).decode(ENCODING, "replace") for v, z in zip(x, zipped, strict=True)], dtype=object)

    return opened(data, is_compressed)


def blobs(pages: DataFrame, key: str, text: str, compress: bool = True) -> DataFrame:
    """``(key, data, is_compressed)`` of pages, to be merged into a store by key."""
    return pages.select(F.col(key).alias("key"), packed(F.col(text), compress).alias("data"), F.lit(compress).alias("is_compressed"))


def cached_pages(cache: DataFrame, keys: DataFrame) -> DataFrame:
    """``(key, html)`` of the listed keys that the cache holds."""
    return cache.join(keys.select("key").distinct(), "key", "left_semi").select("key", unpacked(F.col("data"), F.col("is_compressed")).alias("html"))


def read_pages(cache: DataFrame, fresh: DataFrame, keys: DataFrame, mode: str) -> DataFrame:
    """``(key, html, is_fresh)`` of the listed keys, from the cache, from ``fresh`` (key, html), or from the latter where the cache has nothing or an empty page.

    A key that is found nowhere has no row.
    """
    wanted = keys.select("key").distinct()
    new = fresh.join(wanted, "key", "left_semi").select("key", "html").withColumn("is_fresh", F.lit(True))
    if mode == FRESH_ONLY:
        return new
    old = cached_pages(cache, wanted).filter(F.coalesce(F.col("html"), F.lit("")) != "").withColumn("is_fresh", F.lit(False))
    return old if mode == CACHE_ONLY else old.unionByName(exclude(new, old, ["key"]))
