"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: blank, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def bounded_runs(sizes: list[int], budget: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes sum to at most ``budget``, one item at least."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > budget:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_words(text: Column) -> Column:
    """The maximal runs of characters other than the six of SPACES."""
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def named(name: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def struct_of(names: list[str]) -> Column:
    """The columns as one struct with fields c0, c1, ..., whatever their names."""
    return F.struct(*(named(c).alias(f"c{k}") for k, c in enumerate(names))) if names else F.struct(F.lit(None).cast("int").alias("none"))


def fields_of(struct: str, names: list[str]) -> list[Column]:
    """The columns that ``struct_of`` put into a struct, with their names."""
    return [F.col(struct)[f"c{k}"].alias(c) for k, c in enumerate(names)]
