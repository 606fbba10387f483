"""Proportional stratified interleaving into shards, in DataFrame operations.

Rows are shuffled by a seeded hash and ranked within their source; the rank over
the source's size is a row's fractional rank. Sorting all rows by it interleaves
the sources in proportion, so that every cut of the sorted order has the
mixture's shares. No source and no shard is ever gathered in one task: both
rankings count rows in hash or value bins first and rank inside a bin only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

SHARDS = 24
SEED = "interleave-1"


def bins_for(rows: int) -> int:
    """Bins of a ranking: about the square root of the rows, a power of two.

    Both what one bin holds and how many bin counts are summed up then grow with
    the root of the table.
    """
    return 1 << max(4, math.ceil(math.log2(4 * math.sqrt(max(rows, 1)))))


def stratified_shards(
    df: DataFrame,
    shards: int = SHARDS,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``(id, source, size, text_crc32, shard, slot)`` of every row.

    Shards hold row counts at most one apart, and each source's rows are spread
    over the shards in proportion. A null source is a source of its own; a null
    text has size 8 and the crc32 of no bytes; a null id ranks like an empty
    one. Rows of equal id are ordered by text; wholly equal rows are
    interchangeable. An empty table gives an empty result. Other columns are
    ignored.
    """
    total = df.count()
    bins = bins_for(total)
    digits = max(1, math.ceil(math.log2(bins) / 4))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.crc32(text.cast("binary")).alias("crc"),
    ).withColumn("draw", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary")))
    rows = rows.withColumn("bin", F.floor(F.conv(F.substring("draw", 1, digits), 16, 10).cast("long") * bins / F.lit(16**digits)))

    per_bin = rows.groupBy("source", "bin").agg(F.count("*").alias("n"))
    by_source = Window.partitionBy("source").orderBy("bin")
    per_bin = per_bin.select(
        F.col("source").alias("source_"),
        F.col("bin").alias("bin_"),
        (F.sum("n").over(by_source) - F.col("n")).alias("before"),
        F.sum("n").over(Window.partitionBy("source")).alias("in_source"),
    )
    inside = Window.partitionBy("source", "bin").orderBy("draw", "id", "crc", "bytes")
    ranked = (
        rows.withColumn("r", F.row_number().over(inside) - 1)
        .join(per_bin, F.col("source").eqNullSafe(F.col("source_")) & (F.col("bin") == F.col("bin_")))
        .withColumn("fraction", (F.col("before") + F.col("r") + 0.5) / F.col("in_source"))
        .withColumnRenamed("bin", "draw_bin")
        .drop("source_", "bin_", "before", "r", "in_source")
        .withColumn("bin", F.floor(F.col("fraction") * bins))
    )
    # Small sources share few fractions, so that equal ones are cut by draw; the cuts of one bin are summed up first.
    cuts = ranked.groupBy("bin", "fraction", "draw_bin").agg(F.count("*").alias("n"))
    per_bin = cuts.groupBy("bin").agg(F.sum("n").alias("n"))
    per_bin = per_bin.select(F.col("bin").alias("bin_"), (F.sum("n").over(Window.orderBy("bin")) - F.col("n")).alias("first"))
    in_bin = F.sum("n").over(Window.partitionBy("bin").orderBy("fraction", "draw_bin")) - F.col("n")
    cuts = cuts.withColumn("inner", in_bin).join(per_bin, F.col("bin") == F.col("bin_"))
    cuts = cuts.select(F.col("bin").alias("b"), F.col("fraction").alias("f"), F.col("draw_bin").alias("d"), (F.col("first") + F.col("inner")).alias("before"))
    inside = Window.partitionBy("bin", "fraction", "draw_bin").orderBy("draw", "source", "id", "crc", "bytes")
    placed = ranked.withColumn("r", F.row_number().over(inside) - 1).join(cuts, (F.col("bin") == F.col("b")) & (F.col("fraction") == F.col("f")) & (F.col("draw_bin") == F.col("d")))
    place = F.col("before") + F.col("r")
    shard = F.expr(f"cast((before + r) * {shards}L div {max(total, 1)}L as int)")
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return placed.select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        (F.col("bytes") + 8).alias("size"),
        F.col("crc").alias("text_crc32"),
        shard.alias("shard"),
        place.alias("place"),
    ).select(id_col, source_col, "size", "text_crc32", "shard", (F.col("place") - first).cast("long").alias("slot"))


def op2_interleave(spark, sf_dir: str) -> DataFrame:
    """Every document's shard and slot, so that each shard has the sources' mixture and row counts differ by one at most.

    Null and empty texts count 8 bytes; null sources and ids are values like
    others; repeated rows each have a slot; an empty table gives no rows.
    """
    out = stratified_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
