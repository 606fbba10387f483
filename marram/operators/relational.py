"""Filters, exclusions, upserts, imports, groupings and rankings over catalogue tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marram.functions.parse import duration_seconds


#: Fixed value: the group of rows without a value.
NOT_SET = "<not set>"


def contains_ci(column: Column, value: str) -> Column:
    """Case-insensitive substring; null never matches."""
    return F.coalesce(F.contains(F.lower(column), F.lit(value.lower())), F.lit(False))


def all_present(fields: dict[str, str | None]) -> Column:
    """Conjunction of substring predicates over the fields that have a value; none is true."""
    return reduce(lambda a, b: a & b, [contains_ci(F.col(c), v) for c, v in fields.items() if v], F.lit(True))


def duration_predicate(seconds: Column, sign: str, value: int | Column) -> Column:
    """Whether a duration compares with a value; without a sign it must be equal. Null never does."""
    return F.coalesce({">": seconds > value, "<": seconds < value, "=": seconds == value}[sign or "="], F.lit(False))


def duration_filter(seconds: Column, wanted: str | None) -> Column:
    """Whether a duration meets a wish such as ``> 10 ч``, ``<05:30`` or ``42``, whose value is read as durations are; no wish is met by all."""
    wanted = (wanted or "").strip()
    if not wanted:
        return F.lit(True)
    sign = wanted[0] if wanted[0] in "<>=" else ""
    return duration_predicate(seconds, sign, duration_seconds(F.lit(wanted[len(sign) :].strip())))


def join_marks(df: DataFrame, marks: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Semi or anti join by keys; null keys are compared as values."""
    marks = marks.select(*(F.col(k).alias(f"{k}_mark") for k in keys)).distinct()
    return df.join(marks, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_mark")) for k in keys]), how)


def marked(df: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with a mark; null keys are compared as values."""
    return join_marks(df, marks, keys, "left_semi")


def exclude(df: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a mark; null keys are compared as values."""
    return join_marks(df, marks, keys, "left_anti")


def visible(df: DataFrame, marks: DataFrame, keys: list[str], include_hidden: bool = False) -> DataFrame:
    """Rows that no mark hides, or all of them."""
    return df if include_hidden else exclude(df, marks, keys)


def first_by(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; the order should be total."""
    made = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__place", F.row_number().over(made)).filter(F.col("__place") <= n).drop("__place")


def upsert(target: DataFrame, changed: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``target`` with changed rows in place of those of equal keys; the first by ``order`` of each key."""
    rows = first_by(changed, keys, order)
    return exclude(target, rows, keys).unionByName(rows)


def import_new(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Only rows whose key is absent are added."""
    return target.unionByName(exclude(incoming, target, keys))


def replace_values(df: DataFrame, dictionary: DataFrame, columns: list[str]) -> DataFrame:
    """Values replaced by (id, property, possible_value, replace_value), lowest id first, whatever the case.

    A dictionary is joined by value, which Spark broadcasts where its own
    threshold allows it.
    """
    for c in columns:
        own = dictionary.filter(F.col("property") == c).withColumn("__key", F.lower("possible_value"))
        own = first_by(own, ["__key"], [F.col("id")]).select("__key", F.col("replace_value").alias("__new"))
        df = df.join(own, F.lower(F.col(c)) == F.col("__key"), "left").withColumn(c, F.coalesce("__new", c)).drop("__key", "__new")
    return df


def hidden_by_values(df: DataFrame, hidden: DataFrame, replacements: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Distinct keys of rows that a hidden value covers.

    ``hidden`` has (property, value, ignore_case, whole_word). A hidden value
    stands for itself and all values it replaces, and is skipped without any
    such value. Whole-word values are joined by equality, others by containment.
    """
    from .matching import contained_in

    alike = replacements.select(F.col("property").alias("p"), F.col("replace_value").alias("r"), F.col("possible_value").alias("v"))
    joined = hidden.join(alike, (F.col("property") == F.col("p")) & (F.col("value") == F.col("r")))
    wanted = joined.select("property", "ignore_case", "whole_word", F.explode(F.array("value", "v")).alias("w")).distinct()
    cells = df.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("property"), F.col(c).alias("cell")) for c in columns))).alias("x")).select(key, "x.property", "x.cell")

    def same_case(c: str) -> Column:
        return F.when(F.col("ignore_case"), F.lower(c)).otherwise(F.col(c))

    whole = wanted.filter("whole_word").select("property", "ignore_case", same_case("w").alias("w")).distinct()
    exact = cells.join(whole.filter("NOT ignore_case"), (cells.property == whole.property) & (F.col("cell") == F.col("w")), "left_semi")
    folded = cells.join(whole.filter("ignore_case"), (cells.property == whole.property) & (F.lower("cell") == F.col("w")), "left_semi")
    part = wanted.filter("NOT whole_word")
    texts = cells.select("property", "cell").distinct()
    held = contained_in(texts, part.filter("NOT ignore_case"), "cell", "w", ("property",)).select("property", F.col("v").alias("cell"))
    low = contained_in(texts.withColumn("low", F.lower("cell")), part.filter("ignore_case").withColumn("w", F.lower("w")), "low", "w", ("property",)).select("property", F.col("v").alias("low"))
    found = cells.join(held.distinct(), ["property", "cell"], "left_semi").unionByName(cells.withColumn("low", F.lower("cell")).join(low.distinct(), ["property", "low"], "left_semi").drop("low"))
    return exact.select(key).unionByName(folded.select(key)).unionByName(found.select(key)).distinct()


def random_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows drawn evenly: those whose key and seed have the least digests. The same rows for a seed, however the table is dealt out; each task hands on ``n`` at most."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key)).cast("binary")), key).limit(n)


def sampled_band(df: DataFrame, score: str, low: float, high: float, key: str, n: int, seed: int) -> DataFrame:
    """A random sample of the rows whose score lies from ``low`` to below ``high``."""
    return random_sample(df.filter((F.col(score) >= low) & (F.col(score) < high)), key, n, seed)


def group_tree(df: DataFrame, values: Column, key: str, caption: Callable[[Column], Column]) -> DataFrame:
    """Groups by first letter and value as rows in order: ``(letter, value, caption, cnt, letter_place, place)``.

    Values merge whatever their case, in the first spelling by key and position,
    which gives letter and caption; a letter's own row has no value. Rows without
    a value make the group ``<not set>``, which is always there. Counts are of
    different keys. Places follow the captions: letters, then values in a letter.
    """
    rows = df.select(F.col(key).alias("__key"), F.posexplode_outer(values).alias("pos", "value"))
    blank = F.coalesce(F.trim("value"), F.lit("")) == ""
    count = F.count_distinct("__key").alias("cnt")
    unset = rows.agg(F.count_distinct(F.when(blank, F.col("__key"))).alias("cnt")).select(F.lit(NOT_SET).alias("letter"), F.lit(None).cast("string").alias("value"), "cnt")
    rows = rows.filter(~blank).withColumn("folded", F.lower("value"))
    first = rows.groupBy("folded").agg(F.min_by("value", F.struct("__key", "pos")).alias("first"))
    letter = F.upper(F.substring("first", 1, 1))
    named = rows.join(first, "folded").withColumn("letter", F.when(letter.rlike(r"^\p{L}$"), letter).otherwise("<other>"))
    by_value = named.groupBy("letter", F.col("first").alias("value")).agg(count)
    by_letter = named.groupBy("letter").agg(count).select("letter", F.lit(None).cast("string").alias("value"), "cnt")
    tree = by_value.unionByName(by_letter).unionByName(unset)
    tree = tree.withColumn("caption", F.concat(F.when(F.col("value").isNull(), F.col("letter")).otherwise(caption(F.col("value"))), F.lit(" ["), "cnt", F.lit("]")))
    places = by_letter.select("letter").unionByName(unset.select("letter")).withColumn("letter_place", F.row_number().over(Window.orderBy("letter")))  # an alphabet's letters
    place = F.row_number().over(Window.partitionBy("letter").orderBy(F.col("value").isNotNull(), "caption")) - 1
    return tree.withColumn("place", place).join(F.broadcast(places), "letter").select("letter", "value", "caption", "cnt", "letter_place", "place")


def facet(df: DataFrame, values: Column, name: str = "value") -> DataFrame:
    """``(value, cnt)``: how many rows have each value; null and empty arrays add none."""
    return df.select(F.explode(values).alias(name)).groupBy(name).agg(F.count("*").alias("cnt"))


def captioned_facet(df: DataFrame, values: Column, caption: Callable[[Column], Column]) -> DataFrame:
    """``(value, caption, cnt)``, the most frequent first, then by value. Values are counted as they are written and captioned afterwards, so that captions may repeat."""
    return facet(df, values).select("value", caption(F.col("value")).alias("caption"), "cnt").orderBy(F.desc("cnt"), "value")


def sorted_values(df: DataFrame, column: str) -> DataFrame:
    """The different values in order, null first."""
    return df.select(column).distinct().orderBy(F.asc_nulls_first(column))


def looked_up(df: DataFrame, lookup: DataFrame, key: str, lookup_key: str, columns: list[str]) -> DataFrame:
    """``df`` with columns of a lookup table by key, and ``found``; rows whose key it lacks stay, with nulls."""
    own = lookup.select(F.col(lookup_key).alias("__lookup"), *columns, F.lit(True).alias("__found"))
    return df.join(own, F.col(key) == F.col("__lookup"), "left").withColumn("found", F.coalesce("__found", F.lit(False))).drop("__lookup", "__found")


@dataclass(frozen=True)
class FilterFields:
    """What a user has filled in, by column; empty values count as none."""

    values: tuple[tuple[str, str], ...] = ()

    def with_value(self, name: str, value: str | None) -> FilterFields:
        """The fields with this one set, or without it where the value is empty."""
        rest = tuple((k, v) for k, v in self.values if k != name)
        return FilterFields(rest + ((name, value),) if value else rest)

    def value(self, name: str) -> str | None:
        return dict(self.values).get(name)

    @property
    def is_empty(self) -> bool:
        return not self.values

    def condition(self, durations: tuple[str, ...] = ()) -> Column:
        """Rows that hold every value, in any case, in its column; values of ``durations`` are wishes for a number of seconds."""
        texts = all_present({k: v for k, v in self.values if k not in durations})
        return reduce(lambda a, b: a & b, [duration_filter(F.col(k), v) for k, v in self.values if k in durations], texts)


def levels(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of every level of a hierarchy; level is how many columns are given."""
    out = df.rollup(*columns).agg(F.count("*").alias("cnt"), F.grouping_id().alias("g"))
    return out.select(*columns, "cnt", (len(columns) - F.expr("bit_count(g)")).cast("int").alias("level"))


def alphabet(df: DataFrame, values: Column, key: str) -> DataFrame:
    """Rows by first letter and value with distinct keys; values merge whatever their case."""
    rows = df.select(key, F.explode(values).alias("value")).select(key, F.lower("value").alias("value"))
    first = F.upper(F.substring("value", 1, 1))
    rows = rows.withColumn("letter", F.when(F.rlike(first, F.lit("^[A-ZА-Я]$")), first).otherwise("<other>"))
    value = rows.groupBy("letter", "value").agg(F.count_distinct(key).alias("cnt"))
    letter = rows.groupBy("letter").agg(F.count_distinct(key).alias("cnt")).select("letter", F.lit(None).cast("string").alias("value"), "cnt")
    return value.unionByName(letter)


def bucket_of(score: Column, n: int = 10) -> Column:
    """Eleven buckets of a tenth, the last for 1 alone."""
    return F.least(F.greatest(F.floor(score * n), F.lit(0)), F.lit(n)).cast("int")


def recency(updated: Column, created: Column, now: Column) -> Column:
    """Age class by fractional days: updated over 30 days ago, else created less than 1 or 7 days ago."""

    def days(since: Column) -> Column:
        return F.timestamp_diff("MICROSECOND", since, now) / 86_400e6

    return F.when(days(updated) > 30, "stale").when(days(created) < 1, "today").when(days(created) < 7, "week").otherwise("older")
