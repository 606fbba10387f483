"""Whole runs over a catalogue: reading pages by site, normalising records, matching them with the reference."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.operators.matching import resolve
from marram.operators.records import canonical_name, normalise_records, overlay
from marram.operators.relational import exclude
from marram.sources.cache import CACHE_ONLY, read_pages


def groups_of_site(groups: DataFrame, site: int) -> DataFrame:
    """Keys of a site's groups, each once."""
    return groups.filter(F.col("web_site_id") == site).select("key").distinct()


def records_of_site(records: DataFrame, groups: DataFrame, site: int) -> DataFrame:
    """Records whose group belongs to a site."""
    return records.join(groups_of_site(groups, site).withColumnRenamed("key", "group_key"), "group_key", "left_semi")


def groups_for(groups: DataFrame, keys: DataFrame, site: int) -> DataFrame:
    """``(key, title, web_site_id)`` of the listed keys: known groups with the site put right, new ones titled by their key."""
    known = groups.select("key", "title").groupBy("key").agg(F.min("title").alias("title"))
    return keys.select("key").distinct().join(known, "key", "left").select("key", F.coalesce("title", "key").alias("title"), F.lit(site).alias("web_site_id"))


def hidden_values_of(hidden: DataFrame, prop: str) -> DataFrame:
    return hidden.filter(F.col("property") == prop)


def is_hidden(records: DataFrame, hidden: DataFrame, keys: list[str]) -> DataFrame:
    """``records`` with whether they are hidden; null keys are compared as values."""
    marks = hidden.select(*(F.col(k).alias(f"{k}_mark") for k in keys), F.lit(True).alias("__hidden")).distinct()
    on = [records[k].eqNullSafe(marks[f"{k}_mark"]) for k in keys]
    return records.join(marks, on, "left").select(*records.columns, F.coalesce("__hidden", F.lit(False)).alias("is_hidden"))


def opened(records: DataFrame, views: DataFrame, key: str, counter: str) -> DataFrame:
    """``records`` with their counters raised by how often each was viewed."""
    seen = views.groupBy(key).agg(F.count("*").alias("__seen"))
    return records.join(seen, key, "left").withColumn(counter, F.coalesce(counter, F.lit(0)) + F.coalesce("__seen", F.lit(0))).drop("__seen")


def reparsed(records: DataFrame, groups: DataFrame, cache: DataFrame, parsers: dict[int, Callable[[DataFrame], DataFrame]], selected: DataFrame | None = None) -> DataFrame:
    """``(web_site_id, key, ...)``: what each site's parser makes of the cached pages of its records.

    A record belongs to the site of its group; records of other groups and sites
    are left out. Without ``selected`` (key) or with an empty one all records are
    read. ``parsers`` take (key, html) and give a row for each key. Write the
    result partitioned by web_site_id.
    """
    sites = groups.filter(F.col("web_site_id").isin(*parsers)).groupBy(F.col("key").alias("group_key")).agg(F.max("web_site_id").alias("web_site_id"))
    routed = records.select("key", "group_key").join(sites, "group_key").select("key", "web_site_id")
    if selected is not None and not selected.isEmpty():
        routed = routed.join(selected.select("key").distinct(), "key", "left_semi")
    out = None
    for site, parser in sorted(parsers.items()):
        keys = routed.filter(F.col("web_site_id") == site)
        found = parser(read_pages(cache, cache.limit(0).select("key", F.lit("").alias("html")), keys, CACHE_ONLY).select("key", "html")).withColumn("web_site_id", F.lit(site))
        out = found if out is None else out.unionByName(found, allowMissingColumns=True)
    return out


def normalised_and_matched(records: DataFrame, replacements: DataFrame, catalogue: DataFrame, authors: DataFrame, books: DataFrame, store: DataFrame, version: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """Records normalised by rule, and the store of matches with those of the normalised records put over it.

    ``catalogue`` has the authors known so far (author), ``authors`` the
    reference's (author_id, surname, given, canonical parts as last_name and
    first_name), ``books`` its books (author_id, book_id, title). The records
    themselves don't change by being matched. Records without a key aren't matched.
    """
    out = normalise_records(records, replacements, "key", catalogue)
    found = resolve(out.filter(F.coalesce("key", F.lit("")) != ""), authors, books)
    names = authors.select(F.col("author_id").alias("author_ref"), canonical_name(F.col("last_name"), F.col("first_name")).alias("author_canonical"))
    titles = books.groupBy(F.col("book_id").alias("book_ref")).agg(F.min("title").alias("book_title"))
    matches = found.join(names, "author_ref", "left").join(titles, "book_ref", "left")
    columns = ["key", "author_ref", "author_conf", "author_canonical", "book_ref", "book_conf", "book_title"]
    return out, overlay(store, matches.select(*columns).withColumn("seq", F.lit(1)), version, now)


def without_site(records: DataFrame, groups: DataFrame, group_col: str = "group_key") -> DataFrame:
    """Records whose group isn't known."""
    return exclude(records, groups.select(F.col("key").alias(group_col)), [group_col])
