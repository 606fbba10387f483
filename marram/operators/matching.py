"""Blocking, fuzzy joins, nearest labels and entity resolution."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType, LongType, StructField, StructType

from marram.functions import fuzzy, text

#: Letters of the substrings by which containment is looked up.
GRAM = 3
#: Remainders that substrings are told apart by before they are joined; characters that are cut at a time.
GRAM_SLOTS, GRAM_SPAN = 1_048_573, 1 << 20
#: Labels that are held at a time.
LABEL_BLOCK = 10_000
#: Components of a task's vectors, a quarter of which is taken at a time (rows of half a megabyte are hard on the JVM), and bytes of the labels' that it meets.
CELLS, SHARE = 1 << 18, 1 << 25
#: Vectors that meet a block of labels at a time; what a score that is no number ranks as: the last.
TILE, NO_SCORE = 256, -2.0
TOP_AUTHORS, AUTHOR_FLOOR, TITLE_FLOOR = 4, 0.80, 0.60


def block_keys(surname: Column) -> Column:
    """A row's blocking keys: the phonetic one and the first three letters."""
    return F.array_distinct(F.array(F.concat(F.lit("m:"), fuzzy.metaphone(surname)), F.concat(F.lit("p:"), fuzzy.prefix_key(surname))))


def blocking_candidates(left: DataFrame, right: DataFrame, left_id: str, left_name: str, right_id: str, right_name: str) -> DataFrame:
    """Distinct (left id, right id) that share a blocking key; empty names have none."""
    def keyed(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.filter(F.col(name) != "").select(F.col(key), F.explode(block_keys(F.col(name))).alias("block"))

    return keyed(left, left_id, left_name).join(keyed(right, right_id, right_name), "block").select(left_id, right_id).distinct()


def fuzzy_band_join(left: DataFrame, right: DataFrame, a: str, b: str, within: int = 2) -> DataFrame:
    """Pairs of distinct values within an edit distance, as (a, b, dist).

    Two strings within distance d share a piece when one is cut into d + 1
    pieces; each piece is joined by equality with the other's substrings of that
    length whose place differs by at most d. Strings of up to d characters have
    no such piece and are joined by length.
    """
    lefts, rights = left.select(F.col(a).alias("a")).dropna().distinct(), right.select(F.col(b).alias("b")).dropna().distinct()
    parts = within + 1
    n = F.length("a")
    cuts = []
    for k in range(parts):
        start, end = F.floor(n * k / parts), F.floor(n * (k + 1) / parts)
        cuts.append(F.struct(n.alias("n"), start.cast("int").alias("at"), F.substring(F.col("a"), start.cast("int") + 1, (end - start).cast("int")).alias("piece")))
    pieces = lefts.filter(n >= parts).select("a", F.explode(F.array(*cuts)).alias("x")).select("a", "x.*")
    m = F.length("b")

    def offer(c: Column) -> Column:
        """The piece that the right side offers to strings of length m + d, for their piece k, if it stands ``shift`` further on."""
        own = m + c["d"]
        start, end = F.floor(own * c["k"] / parts).cast("int"), F.floor(own * (c["k"] + 1) / parts).cast("int")
        at = start + c["shift"]
        fits = (own >= parts) & (at >= 0) & (at + (end - start) <= m)
        return F.when(fits, F.struct(own.alias("n"), start.alias("at"), F.substring(F.col("b"), at + 1, end - start).alias("piece")))

    reach = range(-within, within + 1)
    choices = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(k).alias("k"), F.lit(shift).alias("shift")) for d in reach for k in range(parts) for shift in reach))
    offered = rights.select("b", F.explode(F.array_distinct(F.array_compact(F.transform(choices, offer)))).alias("x")).select("b", "x.*")
    met = pieces.join(offered, ["n", "at", "piece"]).select("a", "b")
    lengths = lefts.filter(n < parts).select("a", F.explode(F.sequence(F.greatest(n - within, F.lit(0)), n + within)).alias("m"))
    short = lengths.join(rights.filter(m < parts + within).select("b", m.alias("m")), "m").select("a", "b") if within else None
    pairs = (met if short is None else met.unionByName(short)).distinct()
    return pairs.withColumn("dist", F.levenshtein("a", "b")).filter(F.col("dist") <= within)


def spans(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts by their places, some GRAM_SPAN characters at a time; a longer text is cut, its parts overlap."""
    places, parts, size = [], [], 0
    for k, x in enumerate(texts):
        for at in range(0, len(x), GRAM_SPAN):
            places.append(k)
            parts.append(x[at : at + GRAM_SPAN + GRAM - 1])
            size += len(parts[-1])
            if size >= GRAM_SPAN:
                yield places, parts
                places, parts, size = [], [], 0
    if parts:
        yield places, parts


def gram_rows(rows: DataFrame, x: str, sought: Broadcast | None = None) -> DataFrame:
    """``rows`` with ``gram`` in place of ``x``: a row for each different substring of GRAM letters, of shorter texts for the whole; no column may have nulls.

    A substring is a number, its code points plus one at 21 bits each. With the
    tables ``sought`` (by length, by remainder) those of all their lengths
    count that a table has; others with the same remainder come along.
    """
    kept = [c for c in rows.columns if c != x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = [batch.column(k) for k in range(len(kept))]
            for places, parts in spans(batch.column(len(kept)).to_pylist()):
                codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.int64) + 1
                sizes = np.array([len(p) for p in parts])
                part = np.repeat(np.arange(len(parts)), sizes)
                for n in range(1, GRAM + 1) if sought is None else sought.value:
                    count = max(0, len(codes) - n + 1)
                    gram = codes[:count]
                    for k in range(1, n):
                        gram = gram << 21 | codes[k : count + k]
                    if sought is None:
                        at = np.flatnonzero((part[:count] == part[n - 1 :]) & ((sizes[part[:count]] == n) | (n == GRAM)))
                    else:
                        at = np.flatnonzero(sought.value[n][gram % GRAM_SLOTS])
                        at = at[part[at] == part[at + n - 1]]
                    gram, place = gram[at], np.array(places)[part[at]]
                    order = np.lexsort((gram, place))
                    gram, place = gram[order], place[order]
                    first = np.ones(len(gram), bool)
                    first[1:] = (gram[1:] != gram[:-1]) | (place[1:] != place[:-1])
                    taken = pa.array(place[first])
                    yield pa.RecordBatch.from_arrays([*(c.take(taken) for c in others), pa.array(gram[first])], [*kept, "gram"])

    filled = StructType([StructField(f.name, f.dataType, False) for f in rows.select(*kept).schema]).add("gram", LongType(), False)
    return rows.select(*kept, x).mapInArrow(run, filled)


def sought_tables(grams: DataFrame) -> Broadcast:
    """By length of substring, which remainders of their numbers occur: at most GRAM places for each of GRAM_SLOTS."""
    n = F.lit(GRAM)
    for k in range(GRAM - 1, 0, -1):
        n = F.when(F.col("gram") < 1 << 21 * k, k).otherwise(n)
    found = grams.select(n.alias("n"), (F.col("gram") % GRAM_SLOTS).alias("slot")).distinct().toArrow()
    sizes, slots = found["n"].to_numpy(), found["slot"].to_numpy()
    tables = {}
    for k in np.unique(sizes).tolist():
        tables[k] = np.zeros(GRAM_SLOTS, bool)
        tables[k][slots[sizes == k]] = True
    return grams.sparkSession.sparkContext.broadcast(tables)


def rows_containing(rows: DataFrame, needles: DataFrame, v: str, w: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` once for each different needle w that stands within their v, equal in the columns ``by``; an empty w stands in all, a null in none.

    A text that holds a needle holds all its substrings of three letters, the
    rarest of them too. So each needle is looked up by the one of its substrings
    that the fewest texts have, and what meets there is compared; needles of one
    or two letters are looked up whole. A needle with a substring that no text
    has is found nowhere. Texts and needles are represented by digests until
    they are compared, and of their substrings only those of needles are kept; for this
    the needles' are read ahead.
    """
    keys, digest = list(by), F.unhex(F.md5(F.col(v).cast("binary"))).alias("__text")
    rows = rows.dropna(subset=[*keys, v])
    needles = needles.select(*keys, w).dropna().distinct()
    empty = needles.filter(F.col(w) == "")
    found = rows.join(empty, keys) if keys else rows.join(F.broadcast(empty))  # at most one needle for each key
    needles = needles.withColumn("__needle", F.unhex(F.sha2(w, 256)))
    asked = gram_rows(needles, w)
    held = gram_rows(rows.select(*keys, digest, v), v, sought_tables(asked)).distinct()
    counts = held.groupBy(*keys, "gram").agg(F.count("*").alias("n"))
    anchors = asked.join(counts, [*keys, "gram"], "left").groupBy(*keys, "__needle").agg(F.min_by(F.struct("gram", "n"), F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("x"))
    anchors = anchors.filter("x.n IS NOT NULL").select(*keys, "__needle", "x.gram").join(needles, [*keys, "__needle"])
    met = held.join(anchors, [*keys, "gram"]).select(*keys, "__text", w)
    compared = rows.select("*", digest).join(met, [*keys, "__text"]).filter(F.contains(v, w))
    return found.unionByName(compared.drop("__text")).select(*rows.columns, w)


def contained_in(values: DataFrame, needles: DataFrame, v: str, w: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of different values (``by``, v, w) where w stands within v, equal in the columns ``by``: ``rows_containing`` of distinct values."""
    values = values.select(*by, F.col(v).alias("v")).dropna().distinct()
    return rows_containing(values, needles.select(*by, F.col(w).alias("w")), "v", "w", by)


def nearest_labels(vectors: DataFrame, labels: DataFrame, id_col: str, vec_col: str, top: int = 1, block: int = LABEL_BLOCK, digits: int | None = None) -> DataFrame:
    """The ``top`` labels of each vector by cosine, as (id, label, score, place); ids should be unique.

    ``labels`` is (label, center). Up to ``block`` labels are scored within each
    vector's row, without a shuffle; more are taken that many at a time, with
    matrix products, and the best of all of them are merged, which gives the
    same result. Scores are compared to ``digits`` decimals, without it as they
    are, of more than a block to twelve. Ties go to the smaller label.
    """
    if labels.count() > block:
        return nearest_by_blocks(vectors, labels, id_col, vec_col, top, block, 12 if digits is None else digits)
    packed = labels.agg(F.array_sort(F.collect_list(F.struct("label", "center"))).alias("all"))  # at most ``block`` rows

    def score(x: Column) -> Column:
        exact = fuzzy.cosine(F.col(vec_col), x["center"])
        return exact if digits is None else F.round(exact, digits)

    scored = vectors.join(F.broadcast(packed)).select(id_col, F.transform("all", lambda x: F.struct((-score(x)).alias("loss"), x["label"].alias("label"))).alias("s"))
    best = scored.select(id_col, F.posexplode(F.slice(F.array_sort("s"), 1, top)).alias("place", "x"))
    return best.select(id_col, F.col("x.label").alias("label"), (-F.col("x.loss")).alias("score"), "place")


def nearest_by_blocks(vectors: DataFrame, labels: DataFrame, id_col: str, vec_col: str, top: int, block: int, digits: int = 12) -> DataFrame:
    """``nearest_labels`` with any number of labels, every vector against every label; nothing of either passes through the driver.

    Tasks take a few thousand vectors and a share of the labels of SHARE bytes
    each, a block of these at a time, and hand on the best of their share. The
    work grows with the product of both numbers; memory doesn't.
    """
    ids, names = vectors.select(F.col(id_col).alias("key"), F.col(vec_col).alias("v")), labels.select(F.col("label").alias("key"), F.col("center").alias("v"))
    count, width = names.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    width, many = max(1, width), ids.count()
    at_most, types = max(1, CELLS // (4 * width)), (component_type(ids), component_type(names))
    dealt = ids.repartition(max(1, -(-many * width // CELLS)))
    ordered = names.repartitionByRange(max(1, -(-count // (16 * block))), "key").sortWithinPartitions("key")
    chunks = vector_blocks(dealt, at_most, width).toDF("ids", "v", "chunk")
    blocks = vector_blocks(ordered, min(block, at_most), width).toDF("labels", "centers", "start")
    pairs = chunks.hint("shuffle_replicate_nl").crossJoin(blocks.repartition(max(1, -(-count * width * types[1].itemsize // SHARE)), "start"))
    kinds = ids.schema["key"].dataType.simpleString(), names.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def units(cells: pa.BinaryScalar, dtype: np.dtype) -> np.ndarray:
            return unit_rows(np.frombuffer(cells.as_buffer(), dtype).reshape(-1, width))

        chunk, best = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                own, v, number, others, centers, start = (batch.column(j)[k] for j in range(6))
                if best is None or number.as_py() != chunk:
                    if best is not None:
                        yield best.rows()
                    chunk, best = number.as_py(), Best(own.values, units(v, types[0]), top, digits)
                best.meet(others.values, units(centers, types[1]), start.as_py())
        if best is not None:
            yield best.rows()

    out = pairs.select("ids", "v", "chunk", "labels", "centers", "start").mapInArrow(run, f"id {kinds[0]}, label {kinds[1]}, score double")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.nanvl("score", F.lit(NO_SCORE))), "label")) - 1
    return out.withColumn("place", place).filter(F.col("place") < top).select(F.col("id").alias(id_col), "label", "score", "place")


def vector_blocks(rows: DataFrame, size: int, width: int) -> DataFrame:
    """Rows (key, v) by ``size`` at most: their keys, their components' bytes, and their place among the partitions' rows; no vector counts as one of zeros."""
    kind, dtype = rows.schema["key"].dataType.simpleString(), component_type(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                keys, v = (c.slice(at, size) for c in batch.columns)
                if v.null_count or v.flatten().null_count or not pc.all(pc.equal(pc.list_value_length(v), width)).as_py():
                    cells = np.array([[0.0] * width if x is None else x for x in v.to_pylist()], dtype)
                else:
                    cells = v.flatten().to_numpy().astype(dtype)
                whole = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
                yield pa.RecordBatch.from_arrays([whole, pa.array([cells.reshape(len(keys), width).tobytes()], pa.binary()), pa.array([start], pa.int64())], ["keys", "cells", "start"])
                start += len(keys)

    return rows.select("key", "v").mapInArrow(run, f"keys array<{kind}>, cells binary, start bigint")


def component_type(rows: DataFrame) -> np.dtype:
    """How the components of the vectors v are held without loss."""
    return np.dtype(np.float32 if rows.schema["v"].dataType.elementType == FloatType() else np.float64)


def scored(cosines: np.ndarray) -> np.ndarray:
    """Cosines, NO_SCORE for what is no number."""
    cosines[np.isnan(cosines)] = NO_SCORE
    return cosines


class Best:
    """The best labels of a chunk of vectors so far, of equal ones the first; labels are known by their places, which are in order.

    Cosines in single precision tell which labels can be among the best; these
    are scored in double precision.
    """

    def __init__(self, ids: pa.Array, units: np.ndarray, top: int, digits: int):
        self.ids, self.units, self.top, self.digits = ids, units, top, digits
        self.scores = np.full((len(units), top), -np.inf)
        self.places = np.full((len(units), top), np.iinfo(np.int64).max)
        self.labels: dict[int, pa.Array] = {}
        self.rough, self.slack = units.astype(np.float32), (units.shape[1] + 8) * 2.0**-24  # no cosine is off by more

    def meet(self, labels: pa.Array, centers: np.ndarray, start: int) -> None:
        """Take in the labels from place ``start`` on, a tile of vectors at a time."""
        self.labels[start] = labels
        rough = np.ascontiguousarray(centers.T, np.float32)
        for at in range(0, len(self.units), TILE):
            self.meet_tile(slice(at, at + TILE), centers, rough, start)

    def meet_tile(self, tile: slice, centers: np.ndarray, rough: np.ndarray, start: int) -> None:
        """Only labels that a vector's worst so far doesn't clearly beat are scored, rounded and sorted."""
        units, worst, last, unit = self.units[tile], self.scores[tile, -1], self.places[tile, -1], 10.0**-self.digits
        near = scored(self.rough[tile] @ rough)
        least = np.where(last > start, worst - 0.6 * unit, worst + 0.4 * unit)
        if len(centers) > self.top and np.isinf(worst).any():
            least = np.maximum(least, np.partition(near, -self.top, axis=1)[:, -self.top] - self.slack - 1.2 * unit)
        hits = np.flatnonzero(near > (least - self.slack).astype(np.float32)[:, None])
        if 32 * len(hits) > near.size:
            exact = scored(units @ centers.T)
            row, column = np.nonzero(exact > least[:, None])
            score = exact[row, column]
        else:
            row, column = np.divmod(hits, len(centers))
            score = scored(np.einsum("ij,ij->i", units[row], centers[column]))
            kept = score > least[row]
            row, column, score = row[kept], column[kept], score[kept]
        if not len(row):
            return
        better = np.unique(row)
        score = np.concatenate([np.round(score, self.digits) + 0.0, self.scores[tile][better].ravel()])
        place = np.concatenate([column + start, self.places[tile][better].ravel()])
        row = np.concatenate([row, np.repeat(better, self.top)])
        order = np.lexsort((place, -score, row))
        first = np.searchsorted(row[order], better)
        taken = order[first[:, None] + np.arange(self.top)]
        self.scores[tile][better], self.places[tile][better] = score[taken], place[taken]

    def rows(self) -> pa.RecordBatch:
        """(id, label, score) of what was found."""
        starts = np.array(sorted(self.labels))
        sizes = np.array([len(self.labels[x]) for x in starts.tolist()])
        row, k = np.nonzero(self.scores > -np.inf)
        place = self.places[row, k]
        block = np.searchsorted(starts, place, "right") - 1
        at = np.cumsum(sizes)[block] - sizes[block] + place - starts[block]
        labels = pa.concat_arrays([self.labels[x] for x in starts.tolist()])
        score = self.scores[row, k]
        score[score == NO_SCORE] = np.nan
        return pa.RecordBatch.from_arrays([self.ids.take(pa.array(row)), labels.take(pa.array(at)), pa.array(score)], ["id", "label", "score"])


def unit_rows(vectors: list[list[float]] | np.ndarray) -> np.ndarray:
    """Vectors of length one; those without length stay zero."""
    found = np.array(vectors, dtype=np.float64)
    size = np.sqrt((found * found).sum(axis=1, keepdims=True))
    return np.divide(found, size, out=np.zeros_like(found), where=size > 0)


def rank_authors(records: DataFrame, authors: DataFrame, id_col: str = "key", author_col: str = "author", top: int = TOP_AUTHORS) -> DataFrame:
    """The best author of each of the ``top`` best-matched people of a record, as (id, author_id, score, place).

    ``authors`` has (author_id, surname, given), normalised. Every reading of
    every person named is looked up by block; a person's best author counts, of
    equal ones the smallest id. People rank by score, then as they are named.
    """
    slots = records.select(F.col(id_col).alias("id"), F.posexplode(text.author_slots(F.col(author_col))).alias("slot", "readings"))
    readings = slots.select("id", "slot", F.explode("readings").alias("r")).select("id", "slot", "r.surname", "r.given").distinct()
    blocks = readings.filter("surname <> ''").select("*", F.explode(block_keys(F.col("surname"))).alias("block"))
    known = authors.filter("surname <> ''").select("author_id", F.col("surname").alias("s2"), F.col("given").alias("g2"), F.explode(block_keys(F.col("surname"))).alias("block"))
    met = blocks.join(known, "block").drop("block").distinct()
    scored = met.withColumn("score", fuzzy.author_score(F.col("surname"), F.col("given"), F.col("s2"), F.col("g2")))
    best = scored.groupBy("id", "slot").agg(F.min_by("author_id", F.struct(-F.col("score"), F.col("author_id"))).alias("author_id"), F.max("score").alias("score"))
    placed = best.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "slot")))
    return placed.filter(F.col("place") <= top).select(F.col("id").alias(id_col), "author_id", "score", "place")


def books_of(books: DataFrame, links: DataFrame) -> DataFrame:
    """``(author_id, book_id, title)``: the books of every author that aren't deleted; ``links`` is (book_id, author_id)."""
    return links.select("book_id", "author_id").distinct().join(books.filter("deleted = 0").select("book_id", "title"), "book_id").select("author_id", "book_id", "title")


def resolve(records: DataFrame, authors: DataFrame, books: DataFrame, id_col: str = "key", author_col: str = "author", title_col: str = "title") -> DataFrame:
    """Author and book of each record with confidences; nulls below the floors.

    ``books`` has (author_id, book_id, title) and may have deleted, whose rows
    other than 0 aren't matched. The author is the best-ranked
    one; the book is sought among those of all the record's best authors by
    token-set ratio, earlier authors and smaller ids first. Every record has a
    row; ids should be unique.
    """
    books = books.filter("deleted = 0") if "deleted" in books.columns else books
    ranked = rank_authors(records, authors, id_col, author_col)
    sure = ranked.filter(F.col("score") >= AUTHOR_FLOOR)
    titles = records.select(F.col(id_col), text.normalize(text.clean_title(F.col(title_col), F.col(author_col))).alias("plain"))
    named = sure.join(titles, id_col).filter("plain <> ''").join(books.select("author_id", "book_id", text.normalize(F.col("title")).alias("book_plain")), "author_id")
    scored = named.withColumn("title_score", fuzzy.token_set_ratio(F.col("plain"), F.col("book_plain")))
    scored = scored.filter(F.col("title_score") >= TITLE_FLOOR)
    order = F.struct(-F.col("title_score"), F.col("place"), F.col("book_id"))
    book = scored.groupBy(id_col).agg(F.min_by(F.struct("author_id", "book_id", "title_score"), order).alias("b"))
    first = sure.filter("place = 1").select(id_col, F.col("author_id").alias("a_id"), F.col("score").alias("a_score"))
    joined = records.select(id_col).join(first, id_col, "left").join(book, id_col, "left")
    return joined.select(
        id_col, F.col("a_id").alias("author_ref"), fuzzy.rounded(F.col("a_score")).alias("author_conf"),
        F.col("b.book_id").alias("book_ref"), fuzzy.rounded(F.col("b.title_score")).alias("book_conf"), F.col("b.author_id").alias("book_author_ref"),
    )


def canonicalise(df: DataFrame, dictionary: DataFrame, value_col: str, within: int = 2) -> DataFrame:
    """``df`` with canonicals and canonical: by equality, then by edit distance, then by contained parts; else null.

    ``dictionary`` has (ord, variant, canonical, part) and may have priority:
    for part rows the variant is sought within the value. The smallest distance
    wins, then the first entry. Of the parts in a value those of the least
    priority count, null being the last; they are joined with the value itself.
    canonicals is sorted and distinct, canonical the same joined by commas.
    """
    values = df.select(F.lower(value_col).alias("v")).dropna().distinct()
    whole = dictionary.filter("NOT part").select("ord", F.lower("variant").alias("w"), "canonical")
    close = fuzzy_band_join(values, whole, "v", "w", within)
    by_distance = close.join(whole, F.col("b") == F.col("w")).groupBy(F.col("a").alias("v")).agg(F.min_by("canonical", F.struct("dist", "ord")).alias("near"))
    priority = (F.col("priority") if "priority" in dictionary.columns else F.lit(None)).cast("long")
    parts = dictionary.filter("part").select(F.lower("variant").alias("w"), "canonical", priority.alias("priority"))
    held = contained_in(values, parts, "v", "w").join(parts, "w").groupBy("v", "priority").agg(F.collect_set("canonical").alias("all"))
    by_part = held.groupBy("v").agg(F.min_by("all", F.struct(F.col("priority").isNull().alias("last"), "priority")).alias("holds"))
    found = values.join(by_distance, "v", "left").join(by_part, "v", "left").select(F.col("v").alias("__v"), "near", "holds")
    joined = df.join(found, F.lower(value_col) == F.col("__v"), "left")
    with_value = F.array_sort(F.array_distinct(F.concat(F.array(F.col(value_col)), F.col("holds"))))
    out = joined.withColumn("canonicals", F.when(F.col("near").isNotNull(), F.array("near")).when(F.col("holds").isNotNull(), with_value))
    return out.withColumn("canonical", F.array_join("canonicals", ", ")).drop("__v", "near", "holds")
