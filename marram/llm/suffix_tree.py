"""Language-model scores from a probabilistic suffix tree over words.

A text is a sequence of symbols: the ALPHABET most frequent words of those that
occur twice, RARE for any other (which is then spelled by bytes), and an end.
Contexts are the last one to DEPTH symbols. A context's next-symbol distribution
is smoothed towards that of its longest suffix state (Witten and Bell). It is a
state itself if it diverges from it: if, over its occurrences, each predicted
without itself, the logarithms of both probabilities' ratio sum to GAIN nats. A
symbol's probability comes from the longest suffix of its history that is a
state, so that the probabilities of all texts sum to one at most.

Whether a context is a state is decided where all positions after it meet:
positions are dealt out by their last symbol, and those after a hot context by
the symbol before it, with the hot context's whole next-symbol counts (at most
one for each symbol of the alphabet) sent along. The tree itself is never
gathered anywhere; it grows with the corpus.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.session import materialize

from .common import bounded_runs, id_remainder, table

#: Most frequent words that are symbols of their own, if they occur LEAST times; then the other symbols' numbers.
ALPHABET = 65_533
LEAST = 2
RARE, END, START = 65_533, 65_534, 65_535
#: Symbols of the longest context. A context and the next symbol fit 64 bits.
DEPTH = 3
#: By how many nats a state must diverge from its suffix.
GAIN = 3.0
#: Positions that one bucket holds on average; contexts of half as many are split.
UNIT = 1 << 21
#: Distinct keys that are judged at a time, unless more follow one symbol.
SLICE = 1 << 18
#: At most so many of the most frequent words, of at most HEAD_BYTES bytes, are broadcast with their counts.
HEAD, HEAD_BYTES = 300_000, 64
#: Entries of a task's counters, and symbols or characters that are handled at a time.
HELD, CHUNK = 500_000, 1 << 21
#: Rows of a hot context that one task adds up, about, and rows of three numbers that may be broadcast.
FAN, BROADCAST_ROWS = 256, 500_000
#: The byte before and after a spelled word, and bytes that no lower-cased word has.
EDGE = 256
NEVER = [*range(9, 14), 32, *range(65, 91), 0xC0, 0xC1, *range(0xF5, 0x100)]


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text and b"" for its end."""
    return [*(text or "").encode().lower().split(), b""]


def count_words(df: DataFrame, text_col: str) -> DataFrame:
    """``(word, n)`` over all texts; the empty word is the end, one for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(words_of(text))
                if len(held) > HELD:
                    yield rows(held)
                    held.clear()
        yield rows(held)

    def rows(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    return df.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(words: DataFrame) -> list[tuple[bytes, int]]:
    """The most frequent words with their counts, HEAD at most, most frequent first; only words above some frequency are in it."""
    level = F.floor(8 * F.log2("n"))
    short = words.filter(F.octet_length("word").between(1, HEAD_BYTES))
    sizes = sorted(((r["level"], r["k"]) for r in short.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect()), reverse=True)  # a few hundred levels
    least, room = None, HEAD
    for at, k in sizes:
        room -= k
        if room < 0:
            break
        least = at
    if least is None:
        return []
    found = short.filter(level >= least).toArrow()
    return sorted(zip(found.column("word").to_pylist(), found.column("n").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))


def framed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All words' bytes with an EDGE before, between and after them, and each word's length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    out = np.full(int(lengths.sum()) + len(words) + 1, EDGE, dtype=np.int64)
    letters = np.frombuffer(b"".join(words), dtype=np.uint8)
    out[np.arange(len(letters)) + np.repeat(np.arange(len(words)), lengths) + 1] = letters
    return out, lengths


def spelling_counts(words: DataFrame, symbols: set[bytes]) -> np.ndarray:
    """How often a byte (or EDGE) follows another in words that aren't symbols; words count as often as they occur."""
    shared = words.sparkSession.sparkContext.broadcast(symbols)
    side = EDGE + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(side * side, dtype=np.int64)
        for batch in batches:
            own = [(w, n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if w and w not in shared.value]
            for i, j in bounded_runs([len(w) for w, _ in own], CHUNK):
                line, lengths = framed([w for w, _ in own[i:j]])
                times = np.repeat([n for _, n in own[i:j]], lengths + 1)
                np.add.at(total, line[:-1] * side + line[1:], times)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], ["cell", "n"])

    out = np.zeros(side * side)
    for r in words.select("word", "n").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most one row for each pair of bytes
        out[r["cell"]] = r["n"]
    return out.reshape(side, side)


def spelling_logs(counts: np.ndarray) -> np.ndarray:
    """log10 chance of a byte or EDGE after another, smoothed; no word is empty. Rows sum to one."""
    plain = counts.sum(axis=0) + 1.0
    plain[NEVER] = 0
    plain /= plain.sum()
    kinds = np.maximum((counts > 0).sum(axis=1, keepdims=True), 1)
    chance = (counts + kinds * plain) / (counts.sum(axis=1, keepdims=True) + kinds)
    chance[EDGE, EDGE] = 0
    chance[EDGE] /= chance[EDGE].sum()
    with np.errstate(divide="ignore"):
        return np.log10(chance)


def spelled(words: list[bytes], logs: np.ndarray) -> np.ndarray:
    """log10 chance of each word's bytes."""
    if not words:
        return np.zeros(0)
    line, lengths = framed(words)
    return np.add.reduceat(logs[line[:-1], line[1:]], np.concatenate(([0], np.cumsum(lengths[:-1] + 1))))


def alphabet_of(head: list[tuple[bytes, int]]) -> list[tuple[bytes, int]]:
    """The words of the head that are symbols."""
    return [x for x in head[:ALPHABET] if x[1] >= LEAST]


def encode_texts(docs: DataFrame, learn: Column, head: list[tuple[bytes, int]], logs: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """A row for each text: id, uid, learn, n_tokens, symbols (16 bits each), spelled, and its base score's parts.

    spelled is the log10 chance of the bytes of its words that aren't symbols;
    n_known and logs cover words of the head, rare lists the others.
    """
    places = {w: k for k, (w, _) in enumerate(head)}
    alphabet = [w for w, _ in alphabet_of(head) if w]
    symbols_to = len(alphabet)
    # What the spelling would give to words of the alphabet goes to the others.
    scale = math.log10(max(1 - float((10.0 ** spelled(alphabet, logs)).sum()), 1e-9))
    counted = np.log10(np.array([n for _, n in head], dtype=np.float64) + 1)
    shared = docs.sparkSession.sparkContext.broadcast((places, counted, logs))
    del places, counted, logs
    kinds = {"id": "long", "uid": "long", "learn": "boolean", "n_tokens": "long", "n_known": "long", "logs": "double", "spelled": "double", "rare": "array<binary>", "symbols": "binary"}

    def described(texts: list[str | None], places: dict, counted: np.ndarray, logs: np.ndarray) -> list[pa.Array]:
        own = [words_of(x) for x in texts]
        flat = [w for x in own for w in x]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        of = np.repeat(np.arange(len(own)), sizes)
        at = np.fromiter(map(places.get, flat, repeat(-1)), np.int64, len(flat))
        symbols = np.where((at < 0) | (at >= symbols_to), RARE, at).astype("<u2")
        ends = np.cumsum(sizes)
        symbols[ends - 1] = END
        odd = np.flatnonzero(symbols == RARE)
        spelling = np.bincount(of[odd], spelled([flat[k] for k in odd], logs) - scale, len(own))
        known = at >= 0
        rare = np.flatnonzero(~known)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(of[rare], minlength=len(own))))), pa.int32()), pa.array([flat[k] for k in rare], pa.binary()))
        data = [symbols[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        counts = [sizes, np.bincount(of[known], minlength=len(own))]
        sums = [np.bincount(of[known], counted[at[known]], len(own)), spelling]
        return [*map(pa.array, counts), *(pa.array(x.astype(np.float64)) for x in sums), lists, pa.array(data, pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for i, j in bounded_runs([len(x or "") for x in texts], CHUNK):
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(3)), *described(texts[i:j], *shared.value)], list(kinds))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("uid"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, ", ".join(f"{c} {kind}" for c, kind in kinds.items()))


def keys_of(symbols: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each position of each text its last three symbols, latest first, and its own, 16 bits each; and the texts' lengths."""
    sizes = np.fromiter((len(x) // 2 for x in symbols), np.int64, len(symbols))
    line = np.full(int(sizes.sum()) + DEPTH * len(symbols), START, dtype=np.uint64)
    places = np.arange(int(sizes.sum())) + DEPTH * np.repeat(np.arange(1, len(symbols) + 1), sizes)
    line[places] = np.frombuffer(b"".join(symbols), dtype="<u2")
    keys = line[places]
    for k in range(1, DEPTH + 1):
        keys |= line[places - k] << np.uint64(16 * (DEPTH + 1 - k))
    return keys, sizes


def context(keys: np.ndarray, depth: int) -> np.ndarray:
    """The last ``depth`` symbols of each key, latest first."""
    return keys >> np.uint64(16 * (DEPTH + 1 - depth))


def mixed(values: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """A number below ``size`` for each value."""
    spread = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((spread ^ (spread >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64) % size


class Hot:
    """Contexts of more than UNIT / 2 positions, by depth, and into how many parts each is split."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.keys: list[np.ndarray] = [np.zeros(0, np.uint64)] * (DEPTH + 1)
        self.parts: list[np.ndarray] = [np.zeros(0, np.int64)] * (DEPTH + 1)

    def put(self, depth: int, sizes: dict[int, int]) -> None:
        chosen = sorted(k for k, n in sizes.items() if 2 * n > UNIT)
        self.keys[depth] = np.array(chosen, dtype=np.uint64)
        self.parts[depth] = np.array([-(-2 * sizes[k] // UNIT) for k in chosen], dtype=np.int64)

    def find(self, keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of keys after a hot context of this depth, and that context's number."""
        own = context(keys, depth)
        at = np.minimum(np.searchsorted(self.keys[depth], own), max(len(self.keys[depth]) - 1, 0))
        hit = np.flatnonzero(self.keys[depth][at] == own) if len(self.keys[depth]) else np.zeros(0, np.int64)
        return hit, at[hit]

    def bucket(self, keys: np.ndarray, uids: np.ndarray) -> np.ndarray:
        """The bucket of each position; after a hot context, one of its parts by the symbol before it (or the text)."""
        out = mixed(context(keys, 1), self.buckets)
        for depth in range(1, DEPTH + 1):
            hit, which = self.find(keys, depth)
            deeper = context(keys[hit], depth + 1) if depth < DEPTH else uids[hit].view(np.uint64)
            out[hit] = (mixed(self.keys[depth][which], self.buckets) + mixed(deeper, self.parts[depth][which])) % self.buckets
        return out

    def targets(self) -> list[tuple[int, int, int]]:
        """(depth, context, bucket) of every bucket that holds positions after a hot context."""
        out = set()
        for depth in range(1, DEPTH + 1):
            for key, parts in zip(self.keys[depth].tolist(), self.parts[depth].tolist(), strict=True):
                first = int(mixed(np.array([key], np.uint64), self.buckets)[0])
                for up in range(1, depth + 1):
                    out |= {(up, key >> 16 * (depth - up), (first + k) % self.buckets) for k in range(min(parts, self.buckets))}
        return sorted(out)


def listed(symbols: np.ndarray, n: np.ndarray) -> bytes:
    """Symbols and their counts in one value."""
    return symbols.astype("<u2").tobytes() + n.astype("<i8").tobytes()


def dense(data: bytes) -> np.ndarray:
    """Counts by symbol."""
    n = len(data) // 10
    out = np.zeros(1 << 16, dtype=np.int64)
    out[np.frombuffer(data, "<u2", n)] = np.frombuffer(data[2 * n :], "<i8", n)
    return out


def hot_counts(encoded: DataFrame, hot: Hot, depth: int, chunks: int) -> DataFrame:
    """``(older, context, data)``: of each hot context of this depth its next symbols' counts in training and, where ``older``, the symbols that often stand before it.

    Each of the texts' ``chunks``, about, gives one row for each hot context;
    about FAN rows of a context are added up at a time, then their sums, in as
    many rounds as that takes.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(hot)
    unit = UNIT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.uint64(0xFFFF)
        for batch in batches:
            learn, uids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            data = batch.column(1).to_pylist()
            for i, j in bounded_runs([len(x) // 2 for x in data], CHUNK):
                piece = int(mixed(uids[i : i + 1], 1 << 30)[0])
                keys, sizes = keys_of(data[i:j])
                hit, which = shared.value.find(keys, depth)
                keys, taught = keys[hit], np.repeat(learn[i:j], sizes)[hit]
                sides = [(False, which[taught] << 16 | (keys[taught] & last).astype(np.int64))]
                if depth < DEPTH:
                    sides.append((True, which << 16 | (context(keys, depth + 1) & last).astype(np.int64)))
                for older, pairs in sides:
                    found, n = np.unique(pairs, return_counts=True)
                    starts = np.flatnonzero(np.concatenate(([True], found[1:] >> 16 != found[:-1] >> 16))) if len(found) else found
                    ends = np.append(starts[1:], len(found))
                    made = [listed(found[a:b] & 0xFFFF, n[a:b]) for a, b in zip(starts, ends, strict=False) if b > a]
                    own = shared.value.keys[depth][found[starts] >> 16].view(np.int64) if len(found) else found
                    yield pa.RecordBatch.from_arrays([pa.array([older] * len(made), pa.bool_()), pa.array(own, pa.int64()), pa.array([piece] * len(made), pa.int64()), pa.array(made, pa.binary())], ["older", "context", "piece", "data"])

    def adding(last: bool):
        def add_up(key: tuple, rows: pa.Table) -> pa.Table:
            total = np.zeros(1 << 16, dtype=np.int64)
            for x in rows.column("data").to_pylist():
                total += dense(x)
            hit = np.flatnonzero(2 * total > unit if last and key[0].as_py() else total)
            return pa.table({"older": pa.array([key[0].as_py()], pa.bool_()), "context": pa.array([key[1].as_py()], pa.int64()), "piece": pa.array([key[2].as_py()], pa.int64()), "data": pa.array([listed(hit, total[hit])], pa.binary())})

        return add_up

    schema = "older boolean, context long, piece long, data binary"
    out, rounds = encoded.select("learn", "symbols", "uid").mapInArrow(run, schema), 1
    while FAN**rounds < chunks:
        rounds += 1
    for k in range(rounds - 1, -1, -1):
        out = out.withColumn("piece", F.col("piece") % F.lit(FAN**k)).groupBy("older", "context", "piece").applyInArrow(adding(k == 0), schema)
    return out.drop("piece")


def find_hot(encoded: DataFrame, sizes: dict[int, int], buckets: int, chunks: int) -> tuple[Hot, DataFrame | None]:
    """Hot contexts (``sizes``: positions after each symbol), and a row (bucket, chunk, depth, context, data) with counts for each bucket that needs them.

    Only contexts whose own suffix is hot can be; there are at most so many as
    units. Their counts have at most one entry for each symbol.
    """
    spark, hot, out = encoded.sparkSession, Hot(buckets), []
    hot.put(1, sizes)
    for depth in range(1, DEPTH + 1):
        if not len(hot.keys[depth]):
            break
        counts = materialize(hot_counts(encoded, hot, depth, chunks), "hot")
        out.append(counts.filter("NOT older").select(F.lit(depth).alias("depth"), "context", "data"))
        if depth < DEPTH:
            large = {}
            for r in counts.filter("older").collect():  # of each hot context, the few symbols that make a hot one again
                total = dense(bytes(r["data"]))
                large |= {r["context"] << 16 | int(k): int(total[k]) for k in np.flatnonzero(total)}
            hot.put(depth + 1, large)
    if not out:
        return hot, None
    blobs = out[0]
    for x in out[1:]:
        blobs = blobs.unionByName(x)
    rows = hot.targets()
    targets = spark.createDataFrame(rows, "depth int, context long, bucket int")
    joined = blobs.join(F.broadcast(targets) if len(rows) <= BROADCAST_ROWS else targets, ["depth", "context"])
    return hot, joined.select("bucket", F.lit(None).cast("long").alias("chunk"), "depth", "context", "data")


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def restored(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def deal(encoded: DataFrame, hot: Hot) -> DataFrame:
    """``(bucket, chunk, depth, context, data)``: the positions of a chunk of texts in a bucket, compressed; chunk is the first text's uid, depth and context are null."""
    shared = encoded.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, learn = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            data = batch.column(2).to_pylist()
            for i, j in bounded_runs([len(x) // 2 for x in data], CHUNK):
                keys, sizes = keys_of(data[i:j])
                of = np.repeat(np.arange(i, j), sizes)
                own = shared.value.bucket(keys, uids[of])
                order = np.argsort(own, kind="stable")
                own, keys, of = own[order], keys[order], of[order]
                starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                ends = np.append(starts[1:], len(own))
                made = [packed(keys[a:b], of[a:b], uids, learn) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(own[starts].astype(np.int32)), pa.array([uids[i]] * len(starts), pa.int64()), pa.nulls(len(starts), pa.int32()), pa.nulls(len(starts), pa.int64()), pa.array(made, pa.binary())], ["bucket", "chunk", "depth", "context", "data"])

    def packed(keys: np.ndarray, of: np.ndarray, uids: np.ndarray, learn: np.ndarray) -> bytes:
        texts, n = np.unique(of, return_counts=True)
        columns = np.ascontiguousarray(keys.view("<u2").reshape(-1, DEPTH + 1).T).view(np.uint8).reshape(DEPTH + 1, -1, 2)
        body = np.ascontiguousarray(columns.transpose(0, 2, 1)).tobytes()
        head = np.array([len(texts), len(keys)], dtype="<i8").tobytes()
        return squeezed(head + uids[texts].tobytes() + n.astype("<i4").tobytes() + learn[texts].astype(np.uint8).tobytes() + body)

    return encoded.select("uid", "learn", "symbols").mapInArrow(run, "bucket int, chunk long, depth int, context long, data binary")


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, and the texts' uids, numbers of keys, and whether they teach."""
    whole = restored(data)
    texts, n = np.frombuffer(whole, "<i8", 2).tolist()
    uids = np.frombuffer(whole, "<i8", texts, 16)
    counts = np.frombuffer(whole, "<i4", texts, 16 + 8 * texts)
    learn = np.frombuffer(whole, np.uint8, texts, 16 + 12 * texts).astype(bool)
    planes = np.frombuffer(whole, np.uint8, 2 * (DEPTH + 1) * n, 16 + 13 * texts).reshape(DEPTH + 1, 2, n)
    keys = np.ascontiguousarray(planes.transpose(2, 0, 1)).reshape(n, -1).view("<u8")[:, 0]
    return keys, uids, counts, learn


def divergence(count: np.ndarray, n: np.ndarray | float, kinds: np.ndarray | int, before: np.ndarray) -> np.ndarray:
    """What each next symbol adds to its context's divergence; 0 for those that never follow and contexts that occur once.

    An occurrence is predicted by the context's other occurrences, smoothed, and
    by the suffix's distribution ``before``.
    """
    left = kinds - (count == 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = ((count - 1) / before + left) / (n - 1 + left)
        return np.where((count > 0) & (n > 1), count * np.log(ratio), 0.0)


def chances(keys: np.ndarray, taught: np.ndarray, root: np.ndarray, whole: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
    """The probability of each key's own symbol from the longest suffix state of its context.

    ``keys`` are distinct and sorted, ``taught`` their counts in training,
    ``root`` the symbols' probabilities without context. ``whole`` has the
    next-symbol counts of hot contexts by (depth, context).
    """
    symbol = (keys & np.uint64(0xFFFF)).astype(np.int64)
    chance = root[symbol]
    known: dict[tuple[int, int], np.ndarray] = {}
    for depth in range(1, DEPTH + 1):
        own = context(keys, depth)
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        pairs = (np.cumsum(np.concatenate(([False], own[1:] != own[:-1]))) << 16) | symbol
        pairs, pair = np.unique(pairs, return_inverse=True) if depth < DEPTH else (pairs, np.arange(len(pairs)))
        count = np.bincount(pair, taught, len(pairs))
        before = np.empty(len(pairs))
        before[pair] = chance
        of = pairs >> 16
        n = np.bincount(of, count, len(starts))
        kinds = np.bincount(of, count > 0, len(starts))
        state = np.bincount(of, divergence(count, n[of], kinds[of], before), len(starts)) >= GAIN
        found = np.where(state[of], (count + kinds[of] * before) / np.maximum(n + kinds, 1)[of], before)
        chance = found[pair]
        for (at, key), counts in sorted(whole.items()):
            if at == depth:
                base = root if depth == 1 else known[depth - 1, key >> 16]
                n_, kinds_ = counts.sum(), np.count_nonzero(counts)
                state_ = divergence(counts, n_, kinds_, base).sum() >= GAIN
                known[depth, key] = (counts + kinds_ * base) / (n_ + kinds_) if state_ else base
                i, j = np.searchsorted(own, np.array([key, key + 1], dtype=np.uint64))
                chance[i:j] = known[depth, key][symbol[i:j]]
    return chance


def score_positions(dealt: DataFrame, root: np.ndarray) -> DataFrame:
    """``(uid, part)``: the log10 probability of each text's symbols.

    A bucket gives one row for each chunk of texts, with its texts' sums there;
    a chunk's rows are then added up, so that their number doesn't depend on how
    many buckets a text's positions are in.
    """
    shared = dealt.sparkSession.sparkContext.broadcast(root)

    def run(rows: pa.Table) -> pa.Table:
        chunks, data = rows.column("chunk").to_pylist(), rows.column("data").to_pylist()
        heads = zip(rows.column("depth").to_pylist(), rows.column("context").to_pylist(), strict=True)
        whole = {head: dense(x) for head, chunk, x in zip(heads, chunks, data, strict=True) if chunk is None}
        parts = [unpacked(x) for chunk, x in zip(chunks, data, strict=True) if chunk is not None]
        chunks = [x for x in chunks if x is not None]
        del data, rows
        if not parts:
            return pa.table({"chunk": pa.array([], pa.int64()), "data": pa.array([], pa.binary())})
        keys, uids, counts, learn = (np.concatenate(x) for x in zip(*parts, strict=True))
        texts = [len(x[1]) for x in parts]
        distinct, at = np.unique(keys, return_inverse=True)
        del keys, parts
        taught = np.bincount(at, np.repeat(learn, counts), len(distinct))
        last = context(distinct, 1)
        firsts = np.append(np.flatnonzero(np.concatenate(([True], last[1:] != last[:-1]))), len(last))
        logs = np.empty(len(distinct))
        for a, b in bounded_runs(np.diff(firsts).tolist(), SLICE):
            i, j = firsts[a], firsts[b]
            own = {x: n for x, n in whole.items() if last[i] <= x[1] >> 16 * (x[0] - 1) <= last[j - 1]}
            logs[i:j] = np.log10(chances(distinct[i:j], taught[i:j], shared.value, own))
        sums = np.add.reduceat(logs[at], np.concatenate(([0], np.cumsum(counts[:-1]))))
        ends = np.cumsum(texts).tolist()
        made = [squeezed(uids[e - n : e].tobytes() + sums[e - n : e].tobytes()) for e, n in zip(ends, texts, strict=True)]
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "data": pa.array(made, pa.binary())})

    def add_up(rows: pa.Table) -> pa.Table:
        both = [np.frombuffer(restored(x), "<i8").reshape(2, -1) for x in rows.column("data").to_pylist()]
        uids, at = np.unique(np.concatenate([x[0] for x in both]), return_inverse=True)
        return pa.table({"uid": pa.array(uids), "part": pa.array(np.bincount(at, np.concatenate([x[1] for x in both]).view("<f8"), len(uids)))})

    return dealt.groupBy("bucket").applyInArrow(run, "chunk long, data binary").groupBy("chunk").applyInArrow(add_up, "uid long, part double")


def score_texts(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, n_known, train_tokens, base_score, score)`` of every row of ``docs``.

    ``learn`` says which rows teach (null: not). score is the tree's log10
    probability of the whole text, base_score that of add-one word frequencies.
    Exact counts of frequent words are broadcast; each other word is joined
    with the table of counts. A null text is an empty one, which is its end
    alone. Without training texts all symbols and bytes are equally likely and
    base_score is 0. Rows keep their multiplicity; other columns are ignored.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    words = materialize(count_words(docs.filter(F.coalesce(learn, F.lit(False))), text_col), "words")
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = words.filter(F.octet_length("word") == 0).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    head = frequent_words(words)
    alphabet = alphabet_of(head)
    logs = spelling_logs(spelling_counts(words, {w for w, _ in alphabet}))
    # The end counts as a known word wherever it was learned.
    encoded = materialize(encode_texts(docs, learn, [*head, (b"", ends)] if ends else head, logs, id_col, text_col), "encoded")
    texts, total = encoded.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    sizes = np.zeros(1 << 16)
    sizes[: len(alphabet)] = [n for _, n in alphabet]
    sizes[END] = ends
    sizes[RARE] = tokens - sizes.sum()
    possible = np.zeros(1 << 16)
    possible[: len(alphabet)] = 1
    possible[[RARE, END]] = 1
    root = (sizes + possible) / (tokens + possible.sum())
    after = {k: math.ceil(n * total / max(tokens, 1)) for k, n in enumerate(sizes.tolist()) if n and k != END} | {START: texts}
    hot, counts = find_hot(encoded, after, max(1, -(-total // UNIT)), max(1, -(-2 * total // CHUNK)))
    dealt = deal(encoded, hot)
    parts = score_positions(dealt if counts is None else dealt.unionByName(counts), root).withColumnRenamed("uid", "uid_")

    rare = encoded.select("uid", F.explode("rare").alias("word"))
    rare = rare.join(words.select(F.col("word").alias("word_"), "n"), F.col("word") == F.col("word_"), "left").groupBy(F.col("uid").alias("rare_uid"))
    rare = rare.agg(F.count("n").alias("more_known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0))).alias("more_logs"))
    norm = math.log10(tokens + distinct + 1)
    out = encoded.select("id", "uid", "n_tokens", "n_known", "logs", "spelled").join(parts, F.col("uid") == F.col("uid_"))
    return out.join(rare, F.col("uid") == F.col("rare_uid"), "left").select(
        F.col("id").alias(id_col), "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("part") + F.col("spelled")).alias("score"),
    )


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id mod 7 is 2; a null id isn't held out."""
    return F.coalesce(id_remainder(F.col(id_col), 7) == 2, F.lit(False))


def op3_suffix_tree(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from those that aren't held out.

    Null and empty texts score their end alone; repeated rows keep their rows,
    and copies count as often as they occur; an empty table gives no rows.
    """
    out = score_texts(table(spark, sf_dir, "documents"), ~held_out())
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
