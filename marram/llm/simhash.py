"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint has 64 bits. By the pigeonhole principle two fingerprints that
differ in at most RADIUS of them agree on some BLOCKS_EQUAL of BLOCKS blocks;
each choice of blocks gives a key, and fingerprints are compared only within a
key. Inside a key they are stored as bit planes, so that one machine word
advances the distances of 64 of them: a carry-save counter adds the planes'
differences bitwise by full adders, and a block is abandoned once all of its distances exceed
the radius.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.session import materialize

from .common import bounded_runs, table
from .links import components

BITS = 64
SHINGLE = 4
SEED = 42
RADIUS = 4
#: At least this many of BLOCKS blocks are equal: BLOCKS - RADIUS.
BLOCKS = 6
#: Fingerprints of one key that one row group holds; a larger key is cut into parts, and pairs of parts are compared.
PART = 2048
#: Rows that make a fingerprint hot, and hot fingerprints whose labels may be broadcast; beyond, adaptive execution splits them.
HOT_ROWS = 1000
CHUNK = 1 << 20
#: Comparisons of a value with a word of 64 others that are made at a time.
CELLS = 1 << 17
#: Characters of shingles that are hashed at a time within one long text.
SPAN = 50_000


def of_hashes(parts: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of the hashes (uint64), which come in parts."""
    totals, n = np.zeros(BITS, dtype=np.int64), 0
    for hashes in parts:
        totals += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * totals > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(len(words) - shingle + 1, 1)
    firsts, lasts = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :][:n].tolist()
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    return of_hashes(np.array([digest(view[a:b], SEED) for a, b in zip(firsts[k : k + SPAN], lasts[k : k + SPAN], strict=True)], dtype="<u8") for k in range(0, n, SPAN))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, passed: list[str] | None = None) -> DataFrame:
    """``(id, fp)``, or the columns ``passed`` and fp; fp is the fingerprint as a signed long."""
    keep = passed or [id_col]
    rows = df.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(keep)), F.col(text_col).alias("t"))
    schema = ", ".join([*(f"c{k} {rows.schema[f'c{k}'].dataType.simpleString()}" for k in range(len(keep))), "fp long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            known: dict[str | None, int] = {}
            for i, j in bounded_runs([len(x or "") for x in texts], CHUNK):
                for x in texts[i:j]:
                    if x not in known:
                        known[x] = fingerprint(x, shingle)
            found = np.array([known[x] for x in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found)], [*(f"c{k}" for k in range(len(keep))), "fp"])

    out = rows.mapInArrow(run, schema)
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(keep)), "fp")


def block_keys(fp: Column, blocks: int, radius: int) -> Column:
    """Array of (choice, key): the fingerprint's bits of each choice of blocks - radius blocks."""
    edges = [round(k * BITS / blocks) for k in range(blocks + 1)]
    masks = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    out = []
    for k, choice in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(masks[c] for c in choice)
        signed = mask - (1 << 64) if mask >> 63 else mask
        out.append(F.struct(F.lit(k).alias("choice"), fp.bitwiseAND(F.lit(signed).cast("long")).alias("key")))
    return F.array(*out)


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes (64, words) of uint64 values, 64 to a word: bit i of word w of plane p is bit p of value 64 w + i."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


def add(digits: list[list[np.ndarray]], over: np.ndarray, vector: np.ndarray) -> None:
    """Add one bit per lane to carry-save digits; what passes the highest is kept in ``over``.

    A digit holds up to two vectors; a third turns them into one of the digit
    and a carry, by a full adder on whole words.
    """
    for held in digits:
        if len(held) < 2:
            held.append(vector)
            return
        a, b = held
        half = a ^ b
        held[:] = [half ^ vector]
        vector = (a & b) | (half & vector)
    over |= vector


def at_least(digits: list[list[np.ndarray]], over: np.ndarray, limit: int) -> np.ndarray:
    """Bits set where the lanes' numbers are ``limit`` or more."""
    none = np.zeros_like(over)
    carry, plain, above = none, [], over
    for held in digits:  # two vectors and a carry to one
        a, b = (*held, none, none)[:2]
        plain.append(a ^ b ^ carry)
        carry = (a & b) | ((a ^ b) & carry)
    above = above | carry
    equal = ~none
    for c in range(len(plain) - 1, -1, -1):
        if limit >> c & 1:
            equal = equal & plain[c]
        else:
            above = above | (equal & plain[c])
            equal = equal & ~plain[c]
    return above | equal


def near(planes: np.ndarray, queries: np.ndarray, words: np.ndarray, radius: int) -> np.ndarray:
    """A word for each (query, word of the planes): a set bit where a stored value is within ``radius`` of the query.

    Planes come eight at a time; a (query, word) cell is abandoned once all its
    64 distances have passed the radius.
    """
    limit = radius + 1
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    digits: list[list[np.ndarray]] = [[] for _ in range(max(limit.bit_length(), 1))]
    over = np.zeros(len(queries), dtype=np.uint64)
    cell = np.arange(len(queries))
    out = np.zeros(len(queries), dtype=np.uint64)
    for bit in range(BITS):
        flip = ((queries >> np.uint64(bit)) & np.uint64(1)) * full
        add(digits, over, planes[bit, words] ^ flip)
        if bit % 8 == 7:
            alive = ~at_least(digits, over, limit) != 0
            if not alive.all():
                queries, words, cell, over = queries[alive], words[alive], cell[alive], over[alive]
                digits = [[x[alive] for x in held] for held in digits]
                if not len(cell):
                    return out
    out[cell] = ~at_least(digits, over, limit)
    return out


class Forest:
    """Union-find over positions; links of a key are reduced to a spanning forest."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def roots(self, places: np.ndarray) -> np.ndarray:
        return np.array([self.root(x) for x in places.tolist()], dtype=np.int64)

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def unit_pairs(values: np.ndarray, starts: np.ndarray, lefts: np.ndarray, ends: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (left, right) of all values within ``radius`` of each other in each unit, a run of comparisons at a time.

    Unit u holds ``values[starts[u]:ends[u]]``. Where lefts[u] is ends[u], each
    of them is compared with those after it; else those before lefts[u] with
    the rest. The compared values of each unit begin a new word of the planes,
    so that many small units are one pass over bit planes.
    """
    alone = lefts == ends
    froms = np.where(alone, starts, lefts)
    sizes = ends - froms
    widths = -(-sizes // 64)
    first = np.concatenate(([0], np.cumsum(widths)))
    filled = np.zeros(int(first[-1]) * 64, dtype=np.uint64)
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    filled[np.repeat(first[:-1] * 64, sizes) + within] = values[np.repeat(froms, sizes) + within]
    planes = planes_of(filled)
    asked = lefts - starts
    unit = np.repeat(np.arange(len(starts)), asked)
    query = np.arange(int(asked.sum())) - np.repeat(np.cumsum(asked) - asked, asked) + starts[unit]
    for i, j in bounded_runs(widths[unit].tolist(), CELLS):
        own = unit[i:j]
        width = widths[own]
        of = np.repeat(np.arange(i, j), width)
        word = np.repeat(first[own], width) + np.arange(len(of)) - np.repeat(np.cumsum(width) - width, width)
        hits = near(planes, values[query[of]], word, radius)
        some = np.flatnonzero(hits)
        for k in range(0, len(some), SPAN):
            part = some[k : k + SPAN]
            bits = np.unpackbits(hits[part].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, lane = np.nonzero(bits)
            ask, at = of[part[row]], word[part[row]]
            u = unit[ask]
            left, right = query[ask], froms[u] + (at - first[u]) * 64 + lane
            real = (right < ends[u]) & (~alone[u] | (right > left))
            yield left[real], right[real]


def spanning(forest: Forest, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Those of the pairs that join what the forest has apart; most links of a dense unit don't."""
    apart = forest.roots(left) != forest.roots(right)
    return [(x, y) for x, y in zip(left[apart].tolist(), right[apart].tolist(), strict=True) if forest.join(x, y)]


def unit_links(values: np.ndarray, starts: np.ndarray, lefts: np.ndarray, ends: np.ndarray, radius: int) -> np.ndarray:
    """Links (n, 2) that connect all values within ``radius`` in each unit of ``unit_pairs``."""
    forest = Forest(len(values))
    out = [x for left, right in unit_pairs(values, starts, lefts, ends, radius) for x in spanning(forest, left, right)]
    return np.array([(values[x], values[y]) for x, y in out], dtype=np.uint64).reshape(-1, 2)


def dealt(keyed: DataFrame, passed: list[str], weight: str | None = None, most: int = 0) -> DataFrame:
    """Rows ``(choice, key, p, q, right, *passed)`` of units of work, each unit together and in order.

    ``keyed`` has (choice, key, *passed). Rows meet within a (choice, key); one
    of more than PART rows is cut into parts by hash, and each pair of parts is
    a unit of its own, (p, p) the part with itself. With ``weight``, the parts
    also have about ``most`` of that column's sum at most.
    """
    weighed = F.sum(weight) / F.lit(most) if weight else F.lit(0.0)
    sizes = keyed.groupBy("choice", "key").agg(F.count("*").alias("n_"), weighed.alias("w_")).filter("n_ > 1")
    sizes = sizes.select(F.col("choice").alias("choice_"), F.col("key").alias("key_"), F.ceil(F.greatest(F.col("n_") / F.lit(PART), "w_")).cast("int").alias("parts"))
    meet = keyed.join(sizes, (F.col("choice") == F.col("choice_")) & (F.col("key") == F.col("key_")))
    own = F.pmod(F.xxhash64(passed[0], "choice"), F.col("parts")).cast("int")
    # A row of part p belongs to the units (p, q) for q >= p as left and (q, p) for q < p as right.
    units = meet.withColumn("own", own).select(
        "choice", "key", *passed, "own", F.explode(F.expr("sequence(0, parts - 1)")).alias("other")
    ).select("choice", "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).alias("right"), *passed)
    return units.repartition("choice", "key", "p", "q").sortWithinPartitions("choice", "key", "p", "q", "right", passed[0])


Units = Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]


def by_unit(of_units: Units) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches of ``dealt`` rows that gives (rows, starts, lefts, ends) of whole units to ``of_units``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if rest is None else pa.concat_tables([rest, now]).combine_chunks()
            columns = [now.column(k).to_numpy() for k in range(4)]
            changed = np.zeros(now.num_rows, dtype=bool)
            for column in columns:
                changed[1:] |= column[1:] != column[:-1]
            starts = np.concatenate(([0], np.flatnonzero(changed)))
            rest = now.slice(int(starts[-1]))
            yield from found(now, columns, starts)
        if rest is not None:
            yield from found(rest, [rest.column(k).to_numpy() for k in range(4)], np.array([0, rest.num_rows]))

    def found(now: pa.Table, columns: list[np.ndarray], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        right = now.column(4).to_numpy(zero_copy_only=False)
        begin, end = starts[:-1], starts[1:]
        before = np.concatenate(([0], np.cumsum(right)))
        two = columns[2][begin] != columns[3][begin]
        middle = np.where(two, end - (before[end] - before[begin]), end)
        useful = (end - begin > 1) & ~(two & ((middle == begin) | (middle == end)))
        return of_units(now, begin[useful], middle[useful], end[useful])

    return run


def link_batch(left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(left)), pa.array(np.ascontiguousarray(right))], ["a", "b"])


def fingerprint_links(unique: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints that connect all that lie within ``radius``.

    Every pair within the radius meets in some key. Units report spanning
    forests, never all pairs.
    """
    keyed = unique.select("fp", F.explode(block_keys(F.col("fp"), blocks, radius)).alias("x")).select("x.choice", "x.key", "fp")

    def links(rows: pa.Table, starts: np.ndarray, lefts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        pairs = unit_links(rows.column(5).to_numpy().view(np.uint64), starts, lefts, ends, radius).view(np.int64)
        yield link_batch(pairs[:, 0], pairs[:, 1])

    return dealt(keyed, ["fp"]).mapInArrow(by_unit(links), "a long, b long")


def candidate_links(keyed: DataFrame, radius: int, least: float) -> DataFrame:
    """``(a, b)``: marks of rows that meet in a key, lie within ``radius`` and may be similar; enough to connect all such of a unit.

    ``keyed`` has (choice, key, mark, fp, n): a row's mark, fingerprint and set
    size. Sets may be similar where the smaller has at least ``least`` of the
    larger's size. A pair can come from several keys.
    """

    def links(rows: pa.Table, starts: np.ndarray, lefts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        mark, fp, n = (rows.column(k).to_numpy() for k in range(5, 8))
        forest = Forest(len(mark))
        for left, right in unit_pairs(fp.view(np.uint64), starts, lefts, ends, radius):
            good = np.minimum(n[left], n[right]) >= least * np.maximum(n[left], n[right])
            left, right = np.array(spanning(forest, left[good], right[good]), dtype=np.int64).reshape(-1, 2).T
            if len(left):
                yield link_batch(np.minimum(mark[left], mark[right]), np.maximum(mark[left], mark[right]))

    return dealt(keyed, ["mark", "fp", "n"]).mapInArrow(by_unit(links), "a long, b long")


def blocks_for(rows: int, radius: int = RADIUS) -> int:
    """Blocks that keep a key's chance members few: 2, 3 or 4 of them must be equal."""
    return radius + (2 if rows < 1 << 26 else 3 if rows < 1 << 31 else 4)


def group_fingerprints(rows: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """From ``(id, uid, fp)``: one row per fingerprint with its best (id, uid), and ``(node, root)`` of linked fingerprints."""
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("best")
    unique = materialize(rows.groupBy("fp").agg(best), "unique")
    links = fingerprint_links(unique, radius, blocks_for(unique.count(), radius))
    return unique, materialize(components(links), "roots")


def label_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``(id, fingerprint, component_id)`` for every row.

    component_id is the smallest id in the component of fingerprints within
    ``radius`` of each other. Null and empty texts have fingerprint zero and are
    linked like any other; a null id is the smallest only where all are null.
    Equal rows fall together, each keeping its row. An empty table gives an
    empty result. Other columns are ignored.
    """
    rows = fingerprints(df, id_col, text_col, shingle).withColumnRenamed(id_col, "id").withColumn("uid", F.lit(0))
    rows = materialize(rows, "fingerprints")
    unique, roots = group_fingerprints(rows, radius)
    joined = unique.join(roots, F.col("fp") == F.col("node"))
    least = joined.groupBy("root").agg(F.min("best").alias("best")).select(F.col("root").alias("root_"), F.col("best.id").alias("component_id"))
    linked = joined.join(least, F.col("root") == F.col("root_")).select("node", "component_id")
    label = unique.join(linked, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("fp_"), F.coalesce("component_id", "best.id").alias("component_id"))
    # Many rows can share a fingerprint: the most common ones' labels are broadcast, so that only the others meet by fingerprint.
    often = materialize(rows.groupBy("fp").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_ROWS).select(F.col("fp").alias("hot")), "often")
    if 0 < often.count() <= HOT_ROWS:
        hot_labels = F.broadcast(label.join(F.broadcast(often), F.col("fp_") == F.col("hot"), "left_semi"))
        hot_rows = rows.join(F.broadcast(often), F.col("fp") == F.col("hot"), "left_semi").join(hot_labels, F.col("fp") == F.col("fp_"))
        out = hot_rows.unionByName(rows.join(F.broadcast(often), F.col("fp") == F.col("hot"), "left_anti").join(label, F.col("fp") == F.col("fp_")))
    else:
        out = rows.join(label, F.col("fp") == F.col("fp_"))
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of their links.

    Null and empty texts have fingerprint zero and link like any other; repeated
    rows keep their rows; an empty table gives no rows.
    """
    return label_near_duplicates(table(spark, sf_dir, "documents"))


def stage_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8), with its columns.

    Null and empty texts are one group; of repeated rows one stays; of equal ids
    the first row; an empty table stays empty.
    """
    from .resemblance import drop_similar  # which compares by this module's fingerprints

    return drop_similar(docs)
