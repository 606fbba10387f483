"""Near-duplicate texts: SimHash for texts that are similar by their word shingles.

Two texts are near-duplicates at a Jaccard similarity of at least SIMILARITY.
SimHash fingerprints of such texts differ in up to RADIUS bits, too many for
keys of equal blocks; so texts meet by min-hash bands instead, which miss a pair
of similarity s with chance (1 - s ** ROWS) ** BANDS, 0.0004 at 0.8 and less
above. Texts that meet are compared by fingerprint, bit-sliced; exact shingle
sets then decide. Texts with equal sets are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.session import forget, materialize, recorded

from .common import bounded_runs, fields_of, named, struct_of
from .links import components
from .simhash import Forest, by_unit, candidate_links, dealt, link_batch, of_hashes, unit_pairs

SHINGLE, SIMILARITY = 5, 0.8
#: Two sets of that similarity differ in about 10 of 64 fingerprint bits, tiny ones in 12; 24 is four standard deviations more.
RADIUS = 24
BANDS, ROWS = 20, 5
SEED = 42
CHUNK = 1 << 20
#: Rows of a number or two that may be broadcast; beyond, they are joined by shuffling.
BROADCAST_ROWS = 2_000_000
#: Shingles of the sets that one part of a key holds, about, and that are looked up at a time.
SET_PART, LOOKED_UP = 1 << 22, 1 << 20
#: Shingles whose permuted hashes are held at a time.
SPAN = 2048
SCALES = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a text of fewer words is one shingle."""
    words = (text or "").encode().lower().split()
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(view[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts)))


def band_keys(hashes: np.ndarray) -> list[int]:
    """One signed key for each band of min-hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(hashes), SPAN):
        mixed = hashes[k : k + SPAN, None] * SCALES[0] + SCALES[1]
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, (mixed * SCALES[0]).min(axis=0))
    bands = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(bands)], dtype=np.uint64).view(np.int64).tolist()


def described(df: DataFrame, text: str, passed: list[str], kinds: str, of_set) -> DataFrame:
    """``passed`` columns and those of schema ``kinds`` that ``of_set`` gives for a text's shingle set."""
    rows = df.select(*passed, F.col(text).alias("__t"))
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in passed), kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(passed)).to_pylist()
            for i, j in bounded_runs([len(x or "") for x in texts], CHUNK):
                cut = batch.slice(i, j - i)
                made = of_set([shingle_set(x) for x in texts[i:j]])
                yield pa.RecordBatch.from_arrays([*cut.columns[: len(passed)], *made.values()], [*passed, *made])
        pa.default_memory_pool().release_unused()  # Spark keeps the worker for later stages

    return rows.mapInArrow(run, schema)


def signature(sets: list[np.ndarray]) -> dict[str, pa.Array]:
    """The set's mark, fingerprint, size and keys."""
    marks = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], dtype=np.uint64).view(np.int64)
    fps = np.array([of_hashes(x[k : k + SPAN] for k in range(0, len(x), SPAN)) for x in sets], dtype=np.uint64).view(np.int64)
    return {"mark": pa.array(marks), "fp": pa.array(fps), "n": pa.array(list(map(len, sets)), pa.int32()), "keys": pa.array(list(map(band_keys, sets)), pa.list_(pa.int64()))}


def members(sets: list[np.ndarray]) -> dict[str, pa.Array]:
    return {"members": pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))}


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    left = sets.select(F.col("mark").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("mark").alias("b"), F.col("members").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("k"))
    return both.filter(F.col("k") / (F.col("n") + F.col("m") - F.col("k")) >= SIMILARITY).select("a", "b")


def shared_counts(one: np.ndarray, members: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many values each set ``members[begin:begin + size]`` shares with ``one``, which is sorted."""
    out = []
    for i, j in bounded_runs(sizes.tolist(), LOOKED_UP):
        own = sizes[i:j]
        edges = np.cumsum(own) - own
        values = members[np.repeat(begins[i:j] - edges, own) + np.arange(int(own.sum()))]
        at = np.minimum(np.searchsorted(one, values), len(one) - 1)
        out.append(np.add.reduceat((one[at] == values).astype(np.int64), edges))
    return np.concatenate(out)


def checked_links(met: DataFrame) -> DataFrame:
    """``(a, b)``: links between similar sets with different roots, enough to connect all such of a unit.

    ``met`` has (choice, key, mark, fp, n, root, members). Fingerprints within
    RADIUS are compared by their sets where they meet, unless they are connected
    by then; so no pair that isn't a link leaves its task.
    """

    def links(rows: pa.Table, starts: np.ndarray, lefts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        mark, fp, n, root = (rows.column(k).to_numpy() for k in range(5, 9))
        lists = rows.column(9).combine_chunks()
        values = lists.flatten().to_numpy().view(np.uint64)
        begins = np.cumsum(n, dtype=np.int64) - n
        of_root, group = np.unique(root, return_inverse=True)
        forest, out = Forest(len(of_root)), []
        for left, right in unit_pairs(fp.view(np.uint64), starts, lefts, ends, RADIUS):
            good = (group[left] != group[right]) & (np.minimum(n[left], n[right]) >= SIMILARITY * np.maximum(n[left], n[right]))
            left, right = left[good], right[good]
            edges = np.flatnonzero(np.diff(left, prepend=-1, append=-1)) if len(left) else []
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                one, others = int(left[i]), right[i:j]
                others = others[forest.roots(group[others]) != forest.root(int(group[one]))]
                if len(others):
                    both = shared_counts(values[begins[one] : begins[one] + n[one]], values, begins[others], n[others].astype(np.int64))
                    alike = others[both / (n[one] + n[others] - both) >= SIMILARITY]
                    out += [(mark[one], mark[x]) for x in alike.tolist() if forest.join(int(group[one]), int(group[x]))]
        pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
        yield link_batch(pairs.min(axis=1), pairs.max(axis=1))

    return dealt(met, ["mark", "fp", "n", "root", "members"], "n", SET_PART).mapInArrow(by_unit(links), "a long, b long")


def similar_links(unique: DataFrame, texts_of, paths: list[str]) -> DataFrame:
    """``(a, b)``: links that connect all similar sets that meet in some band.

    ``unique`` has (mark, fp, n, keys); ``texts_of`` gives (mark, t) of the marks
    listed. First those pairs are checked that would connect all fingerprints
    within RADIUS in a band; then, in bands that they leave unconnected, all
    others within RADIUS. Tables among ``paths``, which lists what is written
    meanwhile, are deleted once they are read.
    """
    keyed = unique.select("mark", "fp", "n", F.posexplode("keys").alias("choice", "key"))
    shared = keyed.groupBy("choice", "key").agg(F.count("*").alias("k")).filter("k > 1").drop("k")
    met = materialize(keyed.join(shared, ["choice", "key"]), "met")
    first = materialize(candidate_links(met, RADIUS, SIMILARITY).distinct(), "first")
    linked = first.select(F.explode(F.array("a", "b")).alias("mark")).distinct()
    sets = materialize(described(texts_of(linked), "t", ["mark"], "members array<bigint>", members), "sets")
    links = materialize(similar(first, sets), "links")
    roots = components(links).select(F.col("node").alias("mark"), "root")
    # A set that no first link names is near no other.
    placed = met.join(linked, "mark", "left_semi").join(roots, "mark", "left").select("choice", "key", "mark", "fp", "n", F.coalesce("root", "mark").alias("root"))
    apart = placed.groupBy("choice", "key").agg((F.min("root") != F.max("root")).alias("apart")).filter("apart").drop("apart")
    open_ = placed.join(apart, ["choice", "key"]).join(sets, "mark").select("choice", "key", "mark", "fp", "n", "root", "members")
    open_ = materialize(open_, "open")
    forget(unique.sparkSession, paths, ("met", "first", "sets", "edges"))  # all that comes of them is in open and links
    return links.unionByName(materialize(checked_links(open_), "links"))


def few(df: DataFrame) -> DataFrame:
    """``df`` with a hint to broadcast it where it has at most BROADCAST_ROWS rows of a number each."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def drop_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group of similar texts: the smallest id, and the first such row where ids repeat.

    Similar texts are linked, and linked texts are one group. Columns stay as
    they are, whatever their names. Null texts count as empty, so that one row
    with an empty text stays. An empty table stays empty.
    """
    with recorded() as paths:
        names = df.columns
        place = f"c{names.index(text_col)}"
        rows = materialize(df.select(struct_of(names).alias("row"), named(id_col).alias("id"), F.monotonically_increasing_id().alias("uid")), "rows")
        marks = materialize(described(rows.withColumn("t", F.col("row")[place]), "t", ["id", "uid"], "mark long, fp long, n int, keys array<bigint>", signature), "signatures")
        best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("best")
        unique = materialize(marks.groupBy("mark").agg(best, F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("keys").alias("keys")), "unique")

        def texts_of(nodes: DataFrame) -> DataFrame:
            chosen = few(materialize(unique.join(nodes, "mark", "left_semi").select(F.col("best.uid").alias("uid"), "mark"), "nodes"))
            return rows.select("uid", F.col("row")[place].alias("t")).join(chosen, "uid").select("mark", "t")

        roots = components(similar_links(unique.select("mark", "fp", "n", "keys"), texts_of, paths))
        joined = unique.join(roots, F.col("mark") == F.col("node"), "left")
        kept = joined.groupBy(F.coalesce("root", "mark").alias("root")).agg(F.min("best").alias("best")).select(F.col("best.uid").alias("uid"))
        dropped = few(materialize(marks.select("uid").join(kept, "uid", "left_anti"), "dropped"))
        forget(df.sparkSession, paths, ("signatures", "unique", "nodes", "open", "links", "edges"))  # the result reads rows and dropped only
    return rows.join(dropped, "uid", "left_anti").select(*fields_of("row", names))
