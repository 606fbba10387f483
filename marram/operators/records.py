"""Lookups, groups, ranks, overlays and normalisation of catalogue records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marram.functions import fuzzy, parse, text

from .matching import nearest_labels
from .relational import exclude, first_by, marked, replace_values


def by_keys(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose key is listed."""
    return df.join(keys.select(column).distinct(), column, "left_semi")


def by_key(df: DataFrame, column: str, value) -> DataFrame:
    """At most one row with this key."""
    return df.filter(F.col(column) == value).limit(1)


def stale(df: DataFrame, updated: str, now: Column, days: float) -> DataFrame:
    """Rows updated more than so many (fractional) days ago; rows without a time aren't."""
    return df.filter(F.timestamp_diff("MICROSECOND", F.col(updated), now) / 86_400e6 > days)


def not_blank(x: Column) -> Column:
    """Whether a value has more than blanks; null hasn't."""
    return F.coalesce(F.trim(x) != "", F.lit(False))


def filtered(df: DataFrame, wanted: Column, enabled: bool = True) -> DataFrame:
    """The rows that a filter wants, or all where it is switched off."""
    return df.filter(wanted) if enabled else df


def site_id(sites: DataFrame, names: DataFrame, id_col: str = "id", name_col: str = "plugin_name") -> DataFrame:
    """``(name, id)`` of every name, whatever its case; new names get the ids after the largest, in alphabetical order."""
    known = sites.select(F.lower(name_col).alias("k"), F.col(id_col).alias("known")).groupBy("k").agg(F.min("known").alias("known"))
    joined = names.select(F.col(name_col).alias("name"), F.lower(name_col).alias("k")).join(known, "k", "left")
    new = joined.filter("known IS NULL").select("k").distinct()  # sites are few: one task may number them
    last = sites.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("last"))
    numbered = new.withColumn("n", F.row_number().over(Window.orderBy("k"))).join(F.broadcast(last)).select("k", (F.col("last") + F.col("n")).alias("made"))
    return joined.join(numbered, "k", "left").select("name", F.coalesce("known", "made").alias(id_col))


def merge_listed(known: DataFrame, listed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Known and newly listed rows by key; the listed values count where they aren't null."""
    new = listed.select(key, *(F.col(c).alias(f"new_{c}") for c in columns))
    return known.select(key, *columns).join(new, key, "full_outer").select(key, *(F.coalesce(f"new_{c}", c).alias(c) for c in columns))


def atoms(df: DataFrame, values: Column, order: str) -> DataFrame:
    """``(atom, cnt)`` whatever the case, in the first spelling by ``order``."""
    rows = df.select(F.col(order).alias("o"), F.posexplode(values).alias("pos", "atom"))
    return rows.groupBy(F.lower("atom").alias("k")).agg(F.min_by("atom", F.struct("o", "pos")).alias("atom"), F.count("*").alias("cnt")).drop("k")


def least_priority(df: DataFrame, keys: list[str], priority: str) -> DataFrame:
    """Rows at their key's least priority; all where none has one."""
    least = F.min(priority).over(Window.partitionBy(*keys))
    return df.withColumn("__least", least).filter(F.col("__least").isNull() | (F.col(priority) == F.col("__least"))).drop("__least")


def replacement_tree(replacements: DataFrame, hidden: DataFrame) -> DataFrame:
    """``(property, replace_value, possible, hidden)``: sorted possible values by property and replacement, and whether the replacement is hidden."""
    tree = replacements.groupBy("property", "replace_value").agg(F.array_sort(F.collect_set("possible_value")).alias("possible"))
    marks = hidden.select(F.col("property").alias("p"), F.col("value").alias("v")).distinct()
    joined = tree.join(marks, (F.col("property") == F.col("p")) & (F.col("replace_value") == F.col("v")), "left")
    return joined.select("property", "replace_value", "possible", F.col("p").isNotNull().alias("hidden"))


def proposals(values: DataFrame, column: str, replacements: DataFrame, prop: str) -> DataFrame:
    """Distinct values, whatever their case, that aren't blank and no replacement covers."""
    mapped = replacements.filter(F.col("property") == prop).select(F.lower("possible_value").alias("k"))
    rows = values.filter(not_blank(F.col(column))).groupBy(F.lower(column).alias("k")).agg(F.min(column).alias("value"))
    return rows.join(mapped, "k", "left_anti").select("value")


def delete_replacements(replacements: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Replacements without those of the given keys."""
    return exclude(replacements, wanted, keys)


def delete_first(df: DataFrame, wanted: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` without the first row of each given key; one row goes, its equals stay. Null keys are compared as values; no column may hold maps."""
    given = marked(df, wanted, keys)
    return exclude(df, wanted, keys).unionByName(given.exceptAll(first_by(given, keys, order)))


def overlay(store: DataFrame, matches: DataFrame, version: str, now: Column) -> DataFrame:
    """The store with matches put over it, with version and time; of equal keys the last match, empty keys skipped.

    ``matches`` has the store's columns (but for version and time) and ``seq``.
    """
    rows = first_by(matches.filter(not_blank(F.col("key"))), ["key"], [F.desc("seq")]).drop("seq")
    rows = rows.withColumn("matcher_version", F.lit(version)).withColumn("matched_utc", now)
    return exclude(store, rows, ["key"]).unionByName(rows, allowMissingColumns=True)


def computed_columns(df: DataFrame, size: str = "size_bytes", bitrate: str = "bitrate", length: str = "length") -> DataFrame:
    """``df`` with parsed_seconds, parsed_kbps and effective_seconds."""
    out = df.withColumn("parsed_seconds", parse.duration_seconds(F.col(length))).withColumn("parsed_kbps", parse.bitrate_kbps(F.col(bitrate)))
    return out.withColumn("effective_seconds", parse.effective_seconds(F.col(size), F.col("parsed_kbps"), F.col("parsed_seconds")))


def cleared(df: DataFrame, columns: list[str], size: str) -> DataFrame:
    """``df`` before a new parse: the columns null, the size 0."""
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in columns} | {size: F.lit(0).cast(df.schema[size].dataType)})


def canonical_name(surname: Column, given: Column) -> Column:
    """``Surname, Given``, or the surname alone."""
    return F.when(F.coalesce(given, F.lit("")) != "", F.concat_ws(", ", surname, given)).otherwise(surname)


def recover_authors(df: DataFrame, known: DataFrame, author: str, title: str) -> DataFrame:
    """``df`` with blank authors taken from the part of the title before `` - ``, where it is a known author whatever its case.

    ``known`` has (name, seq); of several spellings the one of least seq is taken.
    """
    names = known.filter(not_blank(F.col("name"))).groupBy(F.lower("name").alias("__k")).agg(F.min_by("name", F.struct("seq", "name")).alias("__known"))
    head = F.when(F.instr(F.col(title), " - ") > 0, F.lower(F.trim(F.substring_index(title, " - ", 1))))
    blank = ~not_blank(F.col(author))
    joined = df.withColumn("__head", F.when(blank, head)).join(names, F.col("__head") == F.col("__k"), "left")
    return joined.withColumn(author, F.when(blank, F.coalesce("__known", author)).otherwise(F.col(author))).drop("__head", "__k", "__known")


def normalise_records(df: DataFrame, replacements: DataFrame, key: str = "key", catalogue: DataFrame | None = None) -> DataFrame:
    """Replacements of bitrate, publisher, reader, author and genre, composed and recovered authors; a null genre or author becomes empty.

    Authors are recovered from titles by the names that the stored ``catalogue``
    (author) has and by those that the rows' own authors are composed to, before
    replacement; the catalogue's spelling comes first, then that of the least key.
    """
    out = replace_values(df, replacements, ["bitrate", "publisher", "reader"])
    out = out.withColumn("author", text.compose_author(F.col("author"), F.col("author_surname"), F.col("author_name")))
    known = out.select(F.col("author").alias("name"), F.struct(F.lit(1).alias("own"), F.col(key).cast("string").alias("key")).alias("seq"))
    if catalogue is not None:
        known = known.unionByName(catalogue.select(F.col("author").alias("name"), F.struct(F.lit(0).alias("own"), F.col("author").alias("key")).alias("seq")))
    out = recover_authors(replace_values(out, replacements, ["author"]), known, "author", "title")
    out = replace_values(out.withColumn("genre", F.coalesce("genre", F.lit(""))), replacements, ["genre"])
    return out.withColumn("author", F.coalesce("author", F.lit("")))


def hybrid_rerank(vectors: DataFrame, labels: DataFrame, id_col: str, vec_col: str, text_col: str, top: int = 6, weight: float = 0.15) -> DataFrame:
    """``(id, label, score)``: the best of the ``top`` labels by cosine plus ``weight`` times token-set ratio; score stays the cosine.

    ``labels`` has (label, center, descr).
    """
    near = nearest_labels(vectors, labels.select("label", "center"), id_col, vec_col, top)
    texts = near.join(F.broadcast(labels.select("label", "descr")), "label").join(vectors.select(id_col, text_col), id_col)
    blend = F.col("score") + weight * fuzzy.token_set_ratio(text.normalize(F.col(text_col)), text.normalize(F.col("descr")))
    return texts.groupBy(id_col).agg(F.max_by(F.struct("label", "score"), F.struct(blend, -F.col("place"))).alias("x")).select(id_col, "x.label", "x.score")


def mean_pooled(tokens: DataFrame, id_col: str, vec_col: str, mask_col: str) -> DataFrame:
    """Mean of the masked-in token vectors of each id, scaled to length one."""
    cells = tokens.filter(F.col(mask_col) > 0).select(id_col, F.posexplode(vec_col).alias("d", "x")).groupBy(id_col, "d").agg(F.avg("x").alias("x"))
    mean = cells.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda c: c["x"]).alias("v"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return mean.select(id_col, F.transform("v", lambda x: F.try_divide(x, size)).alias("v"))


def least_sure(df: DataFrame, score: str, count: str, n: int = 20, least: int = 3) -> DataFrame:
    """The ``n`` rows of lowest score among those counted ``least`` times at least."""
    return df.filter(F.col(count) >= least).orderBy(score, F.desc(count)).limit(n)


def rounded_time(x: Column, seconds: int) -> Column:
    """A time rounded to the nearest multiple of so many seconds; halves go up."""
    micros = F.unix_micros(x.cast("timestamp"))
    return F.timestamp_micros(F.floor((micros + seconds * 500_000) / (seconds * 1_000_000)).cast("long") * seconds * 1_000_000)


def nearly(a: Column, b: Column, within: float = 0.0005) -> Column:
    """Whether two numbers differ by less than ``within``; null with a null."""
    return F.abs(a - b) < within


def drill_down(records: DataFrame, members: DataFrame, group: str, key: str, wanted: Column) -> DataFrame:
    """Records of a group that meet a filter; ``members`` has (group, key)."""
    return by_keys(records, members.filter(F.col("group") == group), key).filter(wanted)
