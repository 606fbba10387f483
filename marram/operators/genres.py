"""Genres of records brought to a reference list, step by step, and reports of mapped genres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.functions import text
from marram.session import materialize

from .matching import contained_in, fuzzy_band_join
from .records import least_sure

#: Genres of up to so many letters are left out; what is dropped from variants, and from values compared with them.
SHORT, VARIANT_GAPS, VALUE_GAPS = 3, " -.", " -.,"


def plain(x: Column, gaps: str) -> Column:
    return F.translate(F.lower(x), gaps, "")


def reference_steps(values: DataFrame, dictionary: DataFrame, within: int = 2) -> DataFrame:
    """``(v, step, names)``: what each different value (v) is brought to and by which step; values that no step fits have no row.

    ``dictionary`` has (ord, variant, canonical, part, priority). In turn, each
    for what the steps before have left: the repaired value is a canonical name
    itself; its letters are those of a variant, of equal ones the last; they are
    within the distance of one, of equally near ones the first; parts stand in
    it, of which those of the least priority count, all where none has one; or
    the repair has changed it.
    """
    own = values.select("v").dropna().distinct().withColumn("r", text.repair_homoglyphs(F.col("v"), text.GENRE_KEPT)).withColumn("c", plain(F.col("r"), VALUE_GAPS))
    whole = dictionary.filter("NOT part").select("ord", plain(F.col("variant"), VARIANT_GAPS).alias("w"), "canonical")
    variants = whole.groupBy("w").agg(F.max_by("canonical", "ord").alias("canonical"), F.min("ord").alias("ord"))

    def step(rows: DataFrame, name: str, names: Column) -> DataFrame:
        return rows.select("v", F.lit(name).alias("step"), names.alias("names"))

    own = materialize(own, "values")  # each step reads what the one before has left
    def rest(rows: DataFrame, settled: DataFrame) -> DataFrame:
        return materialize(rows.join(settled.select("v"), "v", "left_anti").select("v", "r", "c"), "values")

    exact = own.join(dictionary.select(F.col("canonical").alias("r")).distinct(), "r", "left_semi")
    out, left = step(exact, "reference", F.array("r")), rest(own, exact)
    spelled = left.join(variants.withColumnRenamed("w", "c"), "c")
    out, left = out.unionByName(step(spelled, "variant", F.array("canonical"))), rest(left, spelled)
    near = fuzzy_band_join(left, variants, "c", "w", within).join(variants, F.col("b") == F.col("w")).groupBy(F.col("a").alias("c")).agg(F.min_by("canonical", F.struct("dist", "ord")).alias("canonical"))
    close = left.join(near, "c")
    out, left = out.unionByName(step(close, "distance", F.array("canonical"))), rest(left, close)
    parts = dictionary.filter("part").select(F.lower("variant").alias("w"), "canonical", F.col("priority").cast("long").alias("priority"))
    low = left.withColumn("low", F.lower("r"))
    held = contained_in(low, parts, "low", "w").withColumnRenamed("v", "low").join(parts, "w").groupBy("low", "priority").agg(F.collect_set("canonical").alias("all"))
    best = held.groupBy("low").agg(F.min_by("all", F.struct(F.col("priority").isNull(), "priority")).alias("all"))
    partly = low.join(best, "low")
    out, left = out.unionByName(step(partly, "part", F.concat(F.array("r"), "all"))), rest(left, partly)
    return out.unionByName(step(left.filter("r <> v"), "repaired", F.array("r")))


def normalise_genres(df: DataFrame, dictionary: DataFrame, key: str, column: str, within: int = 2) -> DataFrame:
    """``df`` with the genre column brought to the reference list; records none of whose genres fits keep theirs.

    The names of a record's genres are joined by commas, each once and in order
    of characters. Keys should be unique; null and empty genres stay.
    """
    rows = df.select(key, F.explode(text.genres(F.col(column))).alias("v")).filter(F.length("v") > SHORT)
    found = reference_steps(rows, dictionary, within)
    named = rows.join(found, "v").groupBy(key).agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))), ", ").alias("__genre"))
    return df.join(named, key, "left").withColumn(column, F.coalesce("__genre", column)).drop("__genre")


def mapping_report(mapped: DataFrame, threshold: float, n: int = 20, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Of mapped genres (atom, cnt, label, score): one row with their number, uses and the shares of both that reach the threshold; and the least sure of those used often."""
    sure = F.col("score") >= threshold
    total = mapped.agg(
        F.count("*").alias("atoms"), F.sum("cnt").alias("uses"), F.try_divide(F.count_if(sure).cast("double"), F.count("*")).alias("atom_share"), F.try_divide(F.sum(F.when(sure, F.col("cnt")).otherwise(0)).cast("double"), F.sum("cnt")).alias("use_share")
    )
    return total, least_sure(mapped, "score", "cnt", n, least)
