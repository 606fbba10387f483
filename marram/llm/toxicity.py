"""Toxicity from the nearest labelled texts by TF-IDF cosine, through a block-max inverted index.

A bounded sample of labelled texts teaches: its terms that stand in texts of one
label more often than chance makes likely are the vocabulary, its texts' vectors
over them the examples. Examples stand in blocks; each term keeps its postings
and its highest weight in each block, so that a text's best similarity with a
block is bounded before the block is read, and blocks that can't reach the best
so far aren't read. The nearest vote by their similarity; what share of the
labels a vote stood for among the examples themselves, each left out in turn,
makes it a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.session import materialize

from .common import id_remainder, named, table
from .terms import lists, term_chunks, term_counts

#: Texts of each label that teach, at most: those with the least hashes.
LABELLED = 4096
#: Terms of the vocabulary at most: those that tell the labels apart best.
VOCABULARY = 4096
#: Terms that get in by chance, at most.
CHANCE = 20
NEIGHBOURS = 25
#: Examples of one block of the index.
BLOCK = 64
#: What the share of label 1 weighs in a vote, as an example of similarity 1.
PRIOR = 0.5
#: Nearest examples that a result names.
NAMED = 3
#: Rows whose terms are counted, and texts that are compared, at a time; results that a worker remembers.
ROWS, TEXTS, REMEMBERED = 512, 256, 1 << 14
#: Blocks that each text reads first, and decimals to which similarities are compared.
FIRST, DIGITS = 3, 9


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str, label_col: str) -> DataFrame:
    """``(h, doc_id, y, t)``: at most LABELLED different texts of each label, y being what most copies of a text are labelled.

    Null labels and ids teach nothing, nor do ids with both labels or texts with
    as many copies of either.
    """
    known = labels.select(named(label_id).alias("doc_id"), named(label_col).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).filter("y = most").drop("most")
    picked = bounded(known, F.xxhash64("doc_id"), "doc_id")
    rows = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("t")).dropna().join(F.broadcast(picked), "doc_id").withColumn("h", F.sha2("t", 256))
    texts = rows.groupBy("h").agg(F.avg("y").alias("share"), F.min("doc_id").alias("doc_id")).filter("share <> 0.5")
    texts = bounded(texts.select("h", "doc_id", (F.col("share") > 0.5).cast("int").alias("y")), F.col("h"), "h")
    found = rows.drop("y").join(F.broadcast(texts), ["h", "doc_id"]).dropDuplicates(["h"])
    return materialize(found.select("h", "doc_id", "y", "t"), "examples")


def bounded(rows: DataFrame, order: Column, then: str) -> DataFrame:
    """The first LABELLED rows of each label in a fixed order, stored."""
    halves = [rows.filter(F.col("y") == y).orderBy(order, then).limit(LABELLED) for y in (0, 1)]
    return materialize(halves[0].unionByName(halves[1]), "picked")


def telling_terms(examples: DataFrame, of_label: list[int]) -> list[tuple[bytes, int]]:
    """(term, texts that hold it) of at most VOCABULARY terms, by the likelihood ratio of their frequencies by label.

    Of all terms, fewer than CHANCE are expected to get in without telling
    anything: a ratio of G has at most a chance of exp(-G / 2).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                cut = batch.slice(k, ROWS)
                found = list(term_chunks(cut.column(1)))
                if not found:
                    continue
                terms = pa.concat_arrays([x for x, _ in found]).dictionary_encode()
                size = len(terms.dictionary)
                pairs = np.unique(np.concatenate([x for _, x in found]) * size + terms.indices.to_numpy())
                y = cut.column(0).to_numpy()[pairs // size]
                counts = [np.bincount(pairs[y == v] % size, minlength=size) for v in (0, 1)]
                yield pa.RecordBatch.from_arrays([terms.dictionary.cast(pa.binary()), *map(pa.array, counts)], ["term", "a0", "a1"])

    counts = materialize(examples.select("y", "t").mapInArrow(run, "term binary, a0 long, a1 long").groupBy("term").agg(F.sum("a0").alias("a0"), F.sum("a1").alias("a1")), "frequencies")
    n0, n1 = of_label

    def mass(x: Column) -> Column:
        return F.when(x > 0, x * F.log(x)).otherwise(0.0)

    a0, a1 = F.col("a0"), F.col("a1")
    ratio = 2 * (mass(a0) + mass(a1) + mass(n0 - a0) + mass(n1 - a1) - mass(a0 + a1) - mass(n0 + n1 - a0 - a1) - mass(F.lit(n0)) - mass(F.lit(n1)) + mass(F.lit(n0 + n1)))
    least = 2 * math.log(max(counts.count() / CHANCE, 2))
    rows = counts.select("term", (a0 + a1).alias("df"), ratio.alias("g")).filter(F.col("g") > least).orderBy(F.desc("g"), "term").limit(VOCABULARY)
    return [(bytes(r["term"]), r["df"]) for r in rows.collect()]


class Index:
    """Examples by vector: those with the same vector are one entry, with its labels' weights; entries stand in blocks."""

    def __init__(self, vocabulary: pa.Array, idf: np.ndarray, weights: tuple[float, float], rows: list[tuple]):
        """``rows`` are examples (id, label, terms, counts), ``weights`` what one example of each label stands for.

        Entries are ordered by their strongest terms, so that blocks differ.
        """
        self.vocabulary, self.idf, self.weights = vocabulary, idf, weights
        groups: dict[tuple, list] = {}
        self.termless = np.zeros(2)
        for doc_id, y, terms, counts in rows:
            if len(terms):
                groups.setdefault((tuple(terms), tuple(counts)), []).append((doc_id, y))
            else:
                self.termless[y] += weights[y]
        strong = {key: tuple(key[0][k] for k in np.argsort(-self.vector(*map(np.array, key)), kind="stable")) for key in groups}
        self.keys = sorted(groups, key=lambda key: (strong[key], key))
        self.votes = np.array([[weights[v] * sum(y == v for _, y in groups[key]) for v in (0, 1)] for key in self.keys]).reshape(-1, 2)
        self.ids = [min(i for i, _ in groups[key]) for key in self.keys]
        total = self.votes.sum(axis=0) + self.termless
        #: The share of label 1.
        self.base = float(total[1] / total.sum()) if total.sum() else 0.0
        #: By block, its terms and the entries' postings (place among the block's terms, entry of the block, weight).
        self.blocks: list[tuple] = []
        self.most = np.zeros((len(idf), -(-len(self.keys) // BLOCK)))
        for k in range(self.most.shape[1]):
            own = self.keys[k * BLOCK : (k + 1) * BLOCK]
            terms = np.concatenate([key[0] for key in own])
            entries = np.repeat(np.arange(len(own)), [len(key[0]) for key in own])
            weight = np.concatenate([self.vector(*map(np.array, key)) for key in own])
            np.maximum.at(self.most[:, k], terms, weight)
            known, place = np.unique(terms, return_inverse=True)
            self.blocks.append((known, place, entries, weight))
        self.raw, self.chance = np.zeros(0), np.zeros(0)

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        found = (1 + np.log(counts)) * self.idf[terms]
        return found / np.sqrt((found * found).sum())

    def nearest(self, keys: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """(entries, similarities) of the NEIGHBOURS nearest of each text (terms, counts), equal similarities by entry; -1 and 0 where fewer have any.

        Similarities are compared to DIGITS decimals. Each text reads the blocks
        of its highest bounds first, then those that can still change its result.
        """
        texts = np.zeros((len(keys), len(self.idf)))
        for k, key in enumerate(keys):
            texts[k, list(key[0])] = self.vector(*map(np.array, key))
        bounds = texts @ self.most
        bounds[bounds > 0] += 10.0**-DIGITS
        best, near = np.full((len(keys), NEIGHBOURS), -1), np.zeros((len(keys), NEIGHBOURS))
        unread = bounds > 0

        def read(b: int, rows: np.ndarray) -> None:
            known, place, entries, weight = self.blocks[b]
            block = np.zeros((len(known), min(BLOCK, len(self.keys) - b * BLOCK)))
            block[place, entries] = weight
            unread[rows, b] = False
            found = np.round(texts[np.ix_(rows, known)] @ block, DIGITS)
            change = found.max(axis=1) >= np.maximum(near[rows, -1], 10.0**-DIGITS)
            rows, found = rows[change], found[change]
            own = np.where(found > 0, np.arange(b * BLOCK, b * BLOCK + block.shape[1]), -1)
            every, sims = np.hstack([best[rows], own]), np.hstack([near[rows], found])
            order = np.lexsort((every, -sims), axis=1)[:, :NEIGHBOURS]
            best[rows], near[rows] = np.take_along_axis(every, order, 1), np.take_along_axis(sims, order, 1)

        first = np.argsort(-bounds, axis=1, kind="stable")[:, :FIRST]
        for b in np.unique(first):
            rows = np.flatnonzero((first == b).any(axis=1) & unread[:, b])
            if len(rows):
                read(b, rows)
        for b in np.argsort(-bounds.max(axis=0, initial=0.0), kind="stable"):
            rows = np.flatnonzero(unread[:, b] & (bounds[:, b] >= near[:, -1]))
            if len(rows):
                read(b, rows)
        return best, near

    def voted(self, best: np.ndarray, near: np.ndarray, votes: np.ndarray) -> np.ndarray:
        """The share of label 1 among votes (texts, NEIGHBOURS, labels), each weighing its squared similarity."""
        sums = (np.where((best >= 0)[:, :, None], votes, 0.0) * (near * near)[:, :, None]).sum(axis=1)
        return (sums[:, 1] + PRIOR * self.base) / (sums.sum(axis=1) + PRIOR)

    def vote(self, keys: list[tuple]) -> tuple[np.ndarray, list[list]]:
        """Each text's share, and the ids of its nearest examples."""
        best, near = self.nearest(keys)
        return self.voted(best, near, self.votes[best]), [[self.ids[k] for k in own[:NAMED] if k >= 0] for own in best]

    def left_out(self, entries: np.ndarray) -> np.ndarray:
        """(entries, labels): the share that an entry's example of each label gets when it is taken out itself."""
        best, near = self.nearest([self.keys[k] for k in entries])
        out = np.zeros((len(entries), 2))
        for y in (0, 1):
            votes = self.votes[best].copy()
            votes[:, :, y] -= np.where(best == entries[:, None], self.weights[y], 0.0)
            out[:, y] = self.voted(best, near, np.maximum(votes, 0.0))
        return out

    def calibrate(self, raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Least squares of the labels under the condition that they rise with the vote, by merging neighbours that don't."""
        raw, place = np.unique(raw, return_inverse=True)
        heavy, positive = np.bincount(place, weight, len(raw)), np.bincount(place, weight * y, len(raw))
        merged: list[list[float]] = []
        for v, p, w in zip(raw, positive, heavy, strict=True):
            merged.append([v * w, p, w])
            while len(merged) > 1 and merged[-2][1] * merged[-1][2] >= merged[-1][1] * merged[-2][2]:
                last = merged.pop()
                merged[-1] = [a + b for a, b in zip(merged[-1], last, strict=True)]
        self.raw = np.array([v / w for v, _, w in merged])
        self.chance = np.array([(p + PRIOR * self.base) / (w + PRIOR) for _, p, w in merged])

    def score(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.raw, self.chance) if len(self.raw) else np.full(len(raw), self.base)


def vectors(df: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """``(doc_id, y, terms, counts)`` of rows (doc_id, y, t)."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, rows, terms, counts = term_counts(batch.column(2), vocabulary)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists(rows, batch.num_rows, pa.array(terms), pa.array(counts))], ["doc_id", "y", "terms", "counts"])

    return df.select("doc_id", "y", "t").mapInArrow(run, f"doc_id {kind}, y int, terms array<long>, counts array<long>")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic") -> Index:
    """The index of a sample of labelled texts, calibrated; the shares of the labels are those of all labelled rows."""
    shares = labels.filter(named(label_col).isin(0, 1)).agg(F.count_if(named(label_col) == 0), F.count_if(named(label_col) == 1)).first()
    examples = sampled(docs, labels, id_col, text_col, label_id, label_col)
    taken = examples.agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).first()
    # An example stands for as many labelled rows as its label's sample leaves to it; on average an example weighs 1.
    scale = sum(taken) / max(sum(shares), 1)
    weights = tuple(float(scale * s / t) if t else 0.0 for s, t in zip(shares, taken, strict=True))
    terms = telling_terms(examples, list(taken)) if all(taken) else []
    terms.sort()
    vocabulary = pa.array([t for t, _ in terms], pa.large_binary())
    idf = np.array([math.log((1 + sum(taken)) / (1 + df)) + 1 for _, df in terms])
    # At most 2 * LABELLED rows, which hold terms of the vocabulary only.
    index = Index(vocabulary, idf, weights, [(r["doc_id"], r["y"], r["terms"], r["counts"]) for r in vectors(examples, vocabulary).collect()])
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                entries = batch.column(0).slice(k, TEXTS)
                own = shared.value.left_out(entries.to_numpy())
                yield pa.RecordBatch.from_arrays([entries, pa.array(own[:, 0]), pa.array(own[:, 1])], ["id", "raw0", "raw1"])

    tasks = max(1, len(index.keys) // (2 * TEXTS))
    seen = docs.sparkSession.range(0, len(index.keys), 1, tasks).mapInArrow(left_out, "id long, raw0 double, raw1 double").toArrow()
    votes = index.votes[seen["id"].to_numpy()]
    raw = np.concatenate([seen["raw0"].to_numpy(), seen["raw1"].to_numpy(), [index.base] * 2])
    weight = np.concatenate([votes[:, 0], votes[:, 1], index.termless])
    y = np.concatenate([np.zeros(len(votes)), np.ones(len(votes)), [0, 1]])
    index.calibrate(raw[weight > 0], y[weight > 0], weight[weight > 0])
    return index


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score, predicted, evidence)`` of every row: the chance of label 1, whether it is 0.5 or more, and ids of the nearest examples.

    Repeated rows stay repeated; null, empty and other texts without a term of
    the vocabulary get the chance of such examples, without evidence; where
    nothing was learned, the share of label 1, 0 without labels.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = shared.value, {}
        plain = float(index.score(np.array([index.base]))[0]), []
        for batch in batches:
            _, rows, terms, counts = term_counts(batch.column(1), index.vocabulary)
            ends = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            keys = {r: (tuple(terms[ends[r] : ends[r + 1]].tolist()), tuple(counts[ends[r] : ends[r + 1]].tolist())) for r in np.unique(rows).tolist()}
            if len(known) > REMEMBERED:
                known.clear()
            fresh = list({key for key in keys.values() if key not in known})
            for k in range(0, len(fresh), TEXTS):
                raw, ids = index.vote(fresh[k : k + TEXTS])
                known.update(zip(fresh[k : k + TEXTS], zip(index.score(raw).tolist(), ids, strict=True), strict=True))
            found = [known[keys[r]] if r in keys else plain for r in range(batch.num_rows)]
            values = pa.array([x for x, _ in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), values, pa.array([int(x >= 0.5) for x, _ in found], pa.int32()), pa.array([x for _, x in found], pa.list_(batch.column(0).type))], ["id", "score", "predicted", "evidence"])

    out = docs.select(named(id_col).alias("id"), named(text_col).alias("t")).mapInArrow(run, f"id {kind}, score double, predicted int, evidence array<{kind}>")
    return out.withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels teach nothing: crc32 of the id mod 5 is 0; a null id isn't held out."""
    return F.coalesce(id_remainder(F.col(id_col), 5) == 0, F.lit(False))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely every document is toxic, learned from labelled ones that aren't held out; nulls, repeats and empty tables as in ``score``."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels").filter(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted", "evidence")
