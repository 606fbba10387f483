"""Packing documents into sequences of fixed length.

Spark encodes the documents and counts pieces by length; those counts (at most
CAPACITY of them, whatever the input) are all that planning needs. The plan
first fixes sets that provably dominate every alternative for their largest
piece (Martello and Toth), then packs the rest best-fit in decreasing order.
A plan's entry covers a run of equal pieces, so pieces are ranked within their
length and looked up; ranking never gathers one length in one task.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marram.session import materialize

from .bpe import PATTERN, REMEMBERED, REMEMBERED_ALONE, VOCABULARY, BytePairs, vocabulary_path
from .common import bounded_runs, table
from .shard import bins_for

CAPACITY = 2048
END = 0
CHUNK = 1 << 20


class FastPairs(BytePairs):
    """The same ids with the library's own merging of a piece."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        super().__init__(path, remembered)
        import tiktoken

        special = set(self.special.values())
        in_order = all(b == a + 1 for a, b in zip(self.made, self.made[1:], strict=False))
        ranks = {x: i for i, x in enumerate(self.pieces) if x and i not in special}
        self.library = tiktoken.Encoding("pieces", pat_str=PATTERN.pattern, mergeable_ranks=ranks, special_tokens={}) if in_order else None

    def encode_piece(self, piece: str) -> bytes:
        if self.library is None:
            return super().encode_piece(piece)
        return np.array(self.library.encode_ordinary(piece), dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def load(name: str, remembered: int = REMEMBERED) -> FastPairs:
    return FastPairs(vocabulary_path(name), remembered)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids; only the first may be shorter than full."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((start, capacity) for start in range(first, n, capacity))]


def encode_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, capacity: int = CAPACITY, remembered: int = REMEMBERED) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: each text's ids and id 0, cut into pieces."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(vocabulary, remembered)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for i, j in bounded_runs([len(x) for x in texts], CHUNK):
                known: dict[str, list[tuple]] = {}
                places, rows = [], []
                for k in range(i, j):
                    found = known.get(texts[k])
                    if found is None:
                        ids = coder.encode(texts[k]) + END.to_bytes(4, "little")
                        view = memoryview(ids)
                        found = [(p, start, length, zlib.crc32(view[4 * start : 4 * (start + length)])) for p, (start, length) in enumerate(cut(len(ids) // 4, capacity))]
                        known[texts[k]] = found
                    places += [k] * len(found)
                    rows += found
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places)), *(pa.array(x, kind) for x, kind in zip(columns, [pa.int32(), pa.int64(), pa.int64(), pa.int64()], strict=True))], names)

    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sums_above(counts: dict[int, int], floor: int, room: int) -> bool:
    """Whether several of the counted sizes sum to more than ``floor`` and at most ``room``."""
    reach, full = 1, (1 << (room + 1)) - 1
    for size in sorted(counts):
        if size > room:
            break
        left, part = min(counts[size], room // size), 1
        while left > 0:
            take = min(part, left)
            reach |= (reach << (size * take)) & full
            left -= take
            part *= 2
        if reach >> (floor + 1):
            return True
    return False


def dominating_sets(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, tuple[int, ...]]], dict[int, int]]:
    """Fixed (times, sizes) sets, and the counts that remain.

    For the largest size j with room r = capacity - j, among what remains:
    nothing fits beside it, so it stands alone; or the largest size k that fits
    is at least every sum of sizes that fits (k = r in particular), so that {j,
    k} dominates each set with j: whatever else stood with j could change places
    with k. Sizes without such a proof stay for best-fit.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    fixed: list[tuple[int, tuple[int, ...]]] = []
    for j in sorted(left, reverse=True):
        while left.get(j):
            room = capacity - j
            left[j] -= 1
            others = {s: n for s, n in left.items() if n > 0 and s <= room}
            left[j] += 1
            if not others:
                fixed.append((left.pop(j), (j,)))
                break
            k = max(others)
            if k < room and sums_above(others, k, room):
                break
            times = left[j] // 2 if k == j else min(left[j], left[k])
            fixed.append((times, (j, k)))
            left[j] -= times
            left[k] -= times
    return fixed, {s: n for s, n in left.items() if n > 0}


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(times, sizes): best-fit decreasing, with equal pieces and equal bins handled together."""
    groups: dict[int, list[tuple[int, tuple]]] = {}
    rooms: list[int] = []  # sorted rooms that have groups

    def put(room: int, times: int, items: tuple) -> None:
        if room not in groups:
            groups[room] = []
            bisect.insort(rooms, room)
        groups[room].append((times, items))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):  # new bins, each with as many of this size as fit
                per = min(capacity // size, n)
                put(capacity - per * size, n // per, ((size, per), None))
                n -= n // per * per
                continue
            room = rooms[at]
            times, items = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[at]
            per = min(room // size, n)
            used = min(times, n // per)
            if used < times:
                put(room, times - used, items)
            put(room - per * size, used, ((size, per), items))
            n -= used * per
    out = []
    for own in groups.values():
        for times, items in own:
            sizes: list[int] = []
            while items is not None:
                (size, per), items = items
                sizes += [size] * per
            out.append((times, tuple(reversed(sizes))))
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, first sequence, offset) sorted by length and rank, and the number of sequences.

    The pieces of that length whose ranks run from the first rank up to the next
    row's lie at that offset, one in each of consecutive sequences.
    """
    fixed, rest = dominating_sets(counts, capacity)
    used = dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    for times, sizes in [*fixed, *best_fit(rest, capacity)]:
        offset = 0
        for size in sizes:
            rows.append((size, used[size], sequence, offset))
            used[size] += times
            offset += size
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4), sequence


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, capacity: int = CAPACITY, remembered: int = REMEMBERED) -> DataFrame:
    """Every document's pieces with their sequence and place in it.

    Columns: id, piece, start, length, ids_crc32, sequence_id, offset. A null or
    empty text is one piece with the end id alone. Rows keep their multiplicity;
    a null id stays null. An empty table gives an empty result. Other columns
    are ignored.
    """
    spark = df.sparkSession
    pieces = materialize(encode_pieces(df, id_col, text_col, vocabulary, capacity, remembered), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    rows, _ = plan(counts, capacity)
    shared = spark.sparkContext.broadcast(rows)
    bins = bins_for(sum(counts.values()))
    binned = pieces.withColumn("bin", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(bins)).cast("int"))
    per_bin = binned.groupBy("length", "bin").agg(F.count("*").alias("n"))
    per_bin = per_bin.select(
        F.col("length").alias("length_"), F.col("bin").alias("bin_"),
        (F.sum("n").over(Window.partitionBy("length").orderBy("bin")) - F.col("n")).alias("before"),
    )
    inside = Window.partitionBy("length", "bin").orderBy("doc_id", "piece", "ids_crc32")
    ranked = binned.withColumn("r", F.row_number().over(inside) - 1).join(per_bin, (F.col("length") == F.col("length_")) & (F.col("bin") == F.col("bin_")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("r")).cast("long").alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, first, sequence, offset = shared.value.T
        keys = size << 48 | first
        for batch in batches:
            rank = batch.column(5).to_numpy()
            at = np.searchsorted(keys, batch.column(3).to_numpy() << 48 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    out = ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("doc_id", id_col)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """Every text's pieces with their sequence and place in it.

    Null and empty texts are one piece with the end id alone; repeated rows are
    packed each for itself; an empty table gives no rows.
    """
    return pack(table(spark, sf_dir, "documents"), remembered=REMEMBERED_ALONE)


def stage_packing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences.

    Null and empty texts are one piece with the end id alone; repeated rows are
    packed each for itself; other columns go; an empty table stays empty.
    """
    return pack(docs)
