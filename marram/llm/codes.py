"""Vector compression: parts of vectors as codes of small codebooks, searched through vantage-point trees.

Vectors become integers and are cut into parts; each part position has a
codebook. A tree over the codebook's entries divides them by their distance to a
vantage entry; a part visits the nearer side first and the other where the
triangle inequality doesn't exclude an entry as near as the best so far. Radii
and distances are square roots in floating point, rounded outwards, and sides at
equality are visited, so that no nearest entry is missed; what is compared in
the end are exact integer distances, equal ones by index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.session import materialize

from .common import named, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Entries that a leaf of a tree holds at most.
LEAF = 2
#: Relative error that a distance in floating point is taken to have, far above that of its square root.
SLACK = 1e-12
#: Rows that are assigned at a time.
ROWS = 1 << 14
#: Squared distances of a part stay below 2 ** DISTANCE_BITS.
DISTANCE_BITS = 62
#: Rows of two numbers that may be broadcast; beyond, they are joined by shuffling.
BROADCAST_ROWS = 1_000_000


def away(squared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A lower and an upper bound of the square root."""
    root = np.sqrt(squared.astype(np.float64))
    return root * (1 - SLACK), root * (1 + SLACK)


class Tree:
    """A vantage-point tree over the entries of one codebook, (entries, width) integers."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self.grow(np.arange(len(entries)))

    def grow(self, own: np.ndarray):
        """(vantage entry, inner entries' side, outer entries' side, the sides' least and greatest distances to it); an array of entries for a leaf."""
        if len(own) <= LEAF:
            return own
        # The vantage entry is the one that lies farthest from the first: entries on the rim divide best.
        squared = self.squared(self.entries[own], own[0])
        vantage = own[int(squared.argmax())]
        rest = own[own != vantage]
        squared = self.squared(self.entries[rest], vantage)
        order = np.argsort(squared, kind="stable")
        rest, (low, high) = rest[order], away(squared[order])
        half = len(rest) // 2
        return vantage, (self.grow(rest[:half]), low[0], high[half - 1]), (self.grow(rest[half:]), low[half], high[-1])

    def squared(self, parts: np.ndarray, entry: int) -> np.ndarray:
        gap = parts - self.entries[entry]
        return (gap * gap).sum(axis=1)

    def assign(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest entry, squared distance) of each part, equal distances to the lower index."""
        best = np.zeros(len(parts), dtype=np.int64)
        least = np.full(len(parts), np.iinfo(np.int64).max)
        self.visit(self.root, parts, np.arange(len(parts)), best, least)
        return best, least

    def offer(self, entry: int, parts: np.ndarray, rows: np.ndarray, best: np.ndarray, least: np.ndarray) -> np.ndarray:
        squared = self.squared(parts[rows], entry)
        better = (squared < least[rows]) | ((squared == least[rows]) & (entry < best[rows]))
        best[rows[better]], least[rows[better]] = entry, squared[better]
        return squared

    def visit(self, node, parts: np.ndarray, rows: np.ndarray, best: np.ndarray, least: np.ndarray) -> None:
        """Let the rows see the entries of a node; the rows' best so far are updated in place."""
        if not len(rows):
            return
        if isinstance(node, np.ndarray):
            for entry in node:
                self.offer(entry, parts, rows, best, least)
            return
        vantage, inner, outer = node
        low, high = away(self.offer(vantage, parts, rows, best, least))
        first = low <= (inner[2] + outer[1]) / 2  # nearer to the inner side
        for own, sides in ((first, (inner, outer)), (~first, (outer, inner))):
            for side, nearest, farthest in sides:
                radius = away(least[rows])[1]
                may = own & (low - farthest <= radius) & (nearest - high <= radius)
                self.visit(side, parts, rows[may], best, least)


def integers(docs: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``(vec_id, label, v)``, v being floor(SCALE * x) of each component, of the rows that have all components.

    The dimension is the most frequent length, the greatest of equals; longer
    and shorter vectors, like those with a null, infinite or undefined component,
    are left out.
    """
    x = named(vector_col)
    rows = docs.select(named(id_col).alias("vec_id"), named(label_col).alias("label"), x.alias("v")).filter(x.isNotNull() & F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))))
    most = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    width = most["width"] if most else 0
    if width % PARTS:
        raise ValueError(f"vectors of {width} components can't be cut into {PARTS} equal parts")
    whole = F.transform("v", lambda c: F.floor(c.cast("double") * SCALE))
    return materialize(rows.filter(F.size("v") == width).select("vec_id", "label", whole.alias("v")), "integers")


def parts_of(batch: pa.RecordBatch, column: int, books: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, (rows, PARTS, width) integers) of runs of a batch."""
    width = books.shape[2] if books.shape[2] else 0
    largest = int(((1 << DISTANCE_BITS) // max(width, 1)) ** 0.5) // 2
    for k in range(0, batch.num_rows, ROWS):
        cut = batch.column(column).slice(k, ROWS)
        found = cut.flatten().to_numpy().reshape(len(cut), PARTS, width)
        if found.size and (found.max() > largest or found.min() < -largest):
            raise ArithmeticError(f"components beyond {largest / SCALE} have distances beyond 64 bits")
        yield k, found


def improve(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the floor of its parts' mean, unused ones as they were."""
    trees = [Tree(b) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, dtype=np.int64), np.zeros(books.shape[:2], dtype=np.int64)
        for batch in batches:
            for _, parts in parts_of(batch, 0, books):
                for p, tree in enumerate(trees):
                    entry, _ = tree.assign(parts[:, p])
                    np.add.at(sums[p], entry, parts[:, p])
                    counts[p] += np.bincount(entry, minlength=books.shape[1])
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    width = books.shape[2]
    sums = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)]
    out = books.copy()
    # One row for each entry of each codebook.
    for r in rows.select("v").mapInArrow(run, "part long, entry long, n long, sums array<long>").groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():
        out[r["part"], r["entry"]] = [r[f"s{k}"] // r["n"] for k in range(width)]
    return out


def first_books(rows: DataFrame) -> np.ndarray:
    """(PARTS, entries, width): the parts of the rows with the smallest ids, null last, equal ids by vector."""
    found = rows.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(ENTRIES).collect()
    width = len(found[0]["v"]) // PARTS if found else 0
    return np.array([r["v"] for r in found], dtype=np.int64).reshape(len(found), PARTS, width).transpose(1, 0, 2).copy()


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``(vec_id, label, code, error)``: each part's nearest entry as two hex digits, and the sum of the squared distances."""
    trees = [Tree(b) for b in books]
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, parts in parts_of(batch, 2, books):
                found = [tree.assign(parts[:, p]) for p, tree in enumerate(trees)]
                codes = np.stack([e for e, _ in found], axis=1).astype(np.uint8)
                error = reduce(np.add, (d for _, d in found))
                cut = batch.slice(k, len(parts))
                yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def spelled(books: np.ndarray) -> str:
    """All components by part, entry and place, as decimal numbers with commas between."""
    return ",".join(map(str, books.ravel().tolist()))


def with_label_totals(rows: DataFrame) -> DataFrame:
    """The rows with label_error, the sum of error over equal labels, nulls together."""
    totals = materialize(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "label_totals")
    same: Column = rows["label"].eqNullSafe(totals["label"])
    small = totals.count() <= BROADCAST_ROWS  # beyond, Spark may split the rows of a common label
    return rows.join(F.broadcast(totals) if small else totals, same).drop(totals["label"])


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, label, code, error)`` of the rows that have all components, and the codebooks.

    Repeated rows stay repeated, ids and labels may be null; fewer rows than
    entries make shorter codebooks, none an empty result.
    """
    rows = integers(vectors, id_col, vector_col, label_col)
    books = first_books(rows)
    if not books.shape[1]:
        return rows.selectExpr("vec_id", "label", "CAST(NULL AS string) AS code", "CAST(NULL AS bigint) AS error"), books
    for _ in range(ROUNDS):
        books = improve(rows, books)
    return materialize(encode(rows, books), "codes"), books


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding's code and error; nulls, repeats and empty tables as in ``compress``."""
    rows, books = compress(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(spelled(books).encode()).hexdigest()
    return with_label_totals(rows).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
