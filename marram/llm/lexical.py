"""Ranked lexical search over an index in tiers of impact.

Documents are kept twice: forward (each with the searched terms that it holds)
and as postings by block of documents and term, each with its impact, the part
of a term's contribution that doesn't depend on the query. For each term the
postings of highest impact make tier 0, the next tier 1, all others tier 2, and
the highest impact below a tier is the term's residual bound there. A search
reads tier 0 only: what stands there gives every document a lower and, with the
residuals, an upper bound. The best by lower bound are scored in full, which
gives the score to beat; where few enough documents can still beat it, these are
scored in full too and the answer is proven exact. Items without that proof go
on to the next tier. With the last tier bounds are scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marram.session import materialize

from .common import named, table
from .terms import lists, term_chunks, term_counts

TOP = 20
#: Share of all documents whose postings of one term make tier 0, and tiers 0 and 1.
SHARES = (1 / 64, 1 / 8)
#: Steps of impact at which a term's postings may be divided, and the highest impact.
BINS, HIGHEST = 64, 1_000_000
#: Documents of one block.
BLOCK = 1 << 13
#: Share of a block's documents that may be left to be scored in full; an item with more goes on to the next tier.
LEFT = 1 / 32
#: Item terms of one search; more items are searched in several passes over the documents.
MAX_TERMS = 1 << 18
#: Rows of three numbers that may be broadcast; beyond, they are joined by shuffling.
BROADCAST_ROWS = 500_000


class Items:
    """Some items: their places, and by item the places of its terms in the vocabulary and how often each stands there."""

    def __init__(self, keys: np.ndarray, terms: pa.Array, counts: np.ndarray):
        self.vocabulary = terms.unique().sort()
        places = pa.compute.index_in(terms, value_set=self.vocabulary).to_numpy()
        order = np.argsort(keys, kind="stable")
        self.keys, firsts = np.unique(keys[order], return_index=True)
        self.terms = np.split(places[order], firsts[1:])
        self.counts = np.split(counts[order], firsts[1:])


def item_terms(items: DataFrame, key: str, text_col: str) -> DataFrame:
    """``(key, term, q)``: the terms of each item and their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, rows in term_chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), terms.cast(pa.binary())], ["key", "term"])

    return items.select(F.col(key).alias("key"), named(text_col).alias("t")).mapInArrow(run, "key long, term binary").groupBy("key", "term").agg(F.count("*").alias("q"))


def forward_index(docs: DataFrame, vocabulary: pa.Array, id_col: str, text_col: str) -> DataFrame:
    """``(block, place, doc_id, n, terms, tfs)``: each document's number of terms, and those of the vocabulary with their occurrences.

    A block is a run of at most BLOCK documents, in it places follow the ids, null last.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                cut = batch.slice(k, BLOCK)
                cut = cut.take(pa.compute.sort_indices(cut, sort_keys=[("doc_id", "ascending")], null_placement="at_end"))
                n, rows, places, counts = term_counts(cut.column(1), shared.value)
                found = lists(rows, cut.num_rows, pa.array(places.astype(np.int32)), pa.array(counts.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(cut.num_rows, block)), pa.array(np.arange(cut.num_rows, dtype=np.int32)), cut.column(0), pa.array(n), *found], ["block", "place", "doc_id", "n", "terms", "tfs"])
                block += 1

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("t"))
    return materialize(rows.mapInArrow(run, f"block long, place int, doc_id {kind}, n long, terms array<int>, tfs array<int>"), "forward")


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What a term that stands ``tf`` times in a document of ``n`` terms adds for each unit of its weight."""
    m = 75 + (25 * n * documents) // length
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def flat(batch: pa.RecordBatch, documents: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row, the term and the impact of each posting of forward rows (n, terms, tfs)."""
    terms, tfs = batch.column("terms"), batch.column("tfs")
    rows = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(terms).to_numpy(zero_copy_only=False))
    n = batch.column("n").to_numpy()
    return rows, terms.flatten().to_numpy(), impacts(tfs.flatten().to_numpy(), n[rows], documents, length)


def bins_of(impact: np.ndarray) -> np.ndarray:
    return np.minimum(impact * BINS // HIGHEST, BINS - 1)


class Levels:
    """By term of a vocabulary: document frequency's weight, the lowest bin of each tier but the last, the residual bound of each tier."""

    def __init__(self, forward: DataFrame, size: int):
        self.documents, self.length = forward.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        documents, length = self.documents, self.length
        self.weights, self.cuts = np.zeros(size, dtype=np.int64), np.zeros((len(SHARES), size), dtype=np.int64)
        self.rests = np.zeros((len(SHARES) + 1, size), dtype=np.int64)
        if not length:
            return

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, top = np.zeros(size * BINS, dtype=np.int64), np.zeros(size * BINS, dtype=np.int64)
            for batch in batches:
                _, term, impact = flat(batch, documents, length)
                key = term.astype(np.int64) * BINS + bins_of(impact)
                total += np.bincount(key, minlength=len(total))
                np.maximum.at(top, key, impact)
            hit = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(hit // BINS), pa.array(hit % BINS), pa.array(total[hit]), pa.array(top[hit])], ["term", "bin", "n", "top"])

        bins = forward.select("n", "terms", "tfs").mapInArrow(run, "term long, bin long, n long, top long").groupBy("term", "bin").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
        above = F.sum("n").over(Window.partitionBy("term").orderBy(F.desc("bin"))) - F.col("n")
        tier = F.lit(0)
        for share in SHARES:
            tier = tier + (above >= max(1, share * documents)).cast("int")
        # One row for each term of the vocabulary, which MAX_TERMS bounds.
        rows = bins.withColumn("tier", tier).groupBy("term").agg(
            F.sum("n").alias("df"),
            *(F.min(F.when(F.col("tier") <= k, F.col("bin"))).alias(f"cut{k}") for k in range(len(SHARES))),
            *(F.coalesce(F.max(F.when(F.col("tier") > k, F.col("top"))), F.lit(0)).alias(f"rest{k}") for k in range(len(SHARES))),
        ).toArrow()
        term = rows["term"].to_numpy()
        self.weights[term] = [math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in rows["df"].to_pylist()]
        for k in range(len(SHARES)):
            self.cuts[k, term], self.rests[k, term] = rows[f"cut{k}"].to_numpy(), rows[f"rest{k}"].to_numpy()


def postings_index(forward: DataFrame, levels: Levels) -> DataFrame:
    """``(block, term, places, impacts, tier)``, in folders by tier; a block's term may have several rows."""
    shared = forward.sparkSession.sparkContext.broadcast(levels.cuts)
    documents, length = levels.documents, levels.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, term, impact = flat(batch, documents, length)
            tier = (bins_of(impact) < shared.value[:, term]).sum(axis=0)
            block, place = batch.column("block").to_numpy()[rows], batch.column("place").to_numpy()[rows]
            order = np.lexsort((place, term, block, tier))
            block, place, term, tier, impact = block[order], place[order], term[order], tier[order], impact[order]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (block[1:] != block[:-1]) | (term[1:] != term[:-1]) | (tier[1:] != tier[:-1])
            first = np.flatnonzero(new)
            own = lists(np.cumsum(new) - 1, len(first), pa.array(place.astype(np.int32)), pa.array(impact.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(block[first]), pa.array(term[first].astype(np.int32)), *own, pa.array(tier[first].astype(np.int32))], ["block", "term", "places", "impacts", "tier"])

    return materialize(forward.select("block", "place", "n", "terms", "tfs").mapInArrow(run, "block long, term int, places array<int>, impacts array<int>, tier int"), "postings", by=["tier"])


def slices_of(postings: pa.Table) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
    """By term, the (places, impacts) of one block."""
    out: dict[int, list] = {}
    postings = postings.combine_chunks()
    for batch in postings.to_batches():
        places, gains = batch.column("places"), batch.column("impacts")
        ends = np.append(0, np.cumsum(pa.compute.list_value_length(places).to_numpy(zero_copy_only=False)))
        flat_places, flat_gains = places.flatten().to_numpy(), gains.flatten().to_numpy().astype(np.int64)
        for k, term in enumerate(batch.column("term").to_pylist()):
            out.setdefault(term, []).append((flat_places[ends[k] : ends[k + 1]], flat_gains[ends[k] : ends[k + 1]]))
    return out


class Search:
    """One search: the items, their terms' levels and both forms of the documents."""

    def __init__(self, forward: DataFrame, items: Items):
        self.spark, self.forward, self.items = forward.sparkSession, forward, items
        self.levels = Levels(forward, len(items.vocabulary))
        self.postings = postings_index(forward, self.levels) if self.levels.length else None
        self.shared = self.spark.sparkContext.broadcast((items, self.levels.weights, self.levels.rests))

    def tiers(self, last: int, open_items: list[int]) -> DataFrame:
        """The postings up to a tier of the terms that open items hold."""
        found = self.postings.filter(F.col("tier") <= last)
        if len(open_items) < len(self.items.keys):
            terms = np.unique(np.concatenate([self.items.terms[k] for k in open_items]))
            found = found.join(F.broadcast(self.spark.createDataFrame(pa.table({"term": pa.array(terms.astype(np.int32))}))), "term", "left_semi")  # MAX_TERMS bounds them
        return found.select("block", "term", "places", "impacts")

    def best(self, tier: int, open_items: list[int]) -> DataFrame:
        """``(item, block, place, bound)``: each open item's TOP documents by lower bound, with all that equal the last of them."""
        shared = self.shared

        def run(postings: pa.Table) -> pa.Table:
            items, weights, _ = shared.value
            own, out = slices_of(postings), []
            block = postings["block"][0].as_py()
            for k in open_items:
                sums = np.zeros(BLOCK, dtype=np.int64)
                for term, q in zip(items.terms[k], items.counts[k], strict=True):
                    for places, gains in own.get(term, ()):
                        sums[places] += q * weights[term] * gains
                hit = np.flatnonzero(sums)
                if len(hit) > TOP:
                    hit = hit[sums[hit] >= np.partition(sums[hit], -TOP)[-TOP]]
                    hit = hit[np.argsort(-sums[hit], kind="stable")[:TOP]]  # by place, and so by id, where equal
                out.append((np.full(len(hit), k, dtype=np.int32), hit.astype(np.int32), sums[hit]))
            item, place, bound = (np.concatenate(x) for x in zip(*out, strict=True))
            return pa.table({"item": item, "block": pa.array(np.full(len(item), block)), "place": place, "bound": bound})

        rows = self.tiers(tier, open_items).groupBy("block").applyInArrow(run, "item int, block long, place int, bound long")
        return rows.withColumn("r", F.rank().over(Window.partitionBy("item").orderBy(F.desc("bound")))).filter(F.col("r") <= TOP).drop("r")

    def rivals(self, tier: int, floors: dict[int, int]) -> DataFrame:
        """``(item, block, places)`` of documents that may reach the item's floor; null places where they are too many in a block."""
        shared = self.shared

        def run(postings: pa.Table) -> pa.Table:
            items, weights, rests = shared.value
            own, out = slices_of(postings), []
            block = postings["block"][0].as_py()
            for k, floor in floors.items():
                rest = rests[tier]
                sums = np.full(BLOCK, int((items.counts[k] * weights[items.terms[k]] * rest[items.terms[k]]).sum()), dtype=np.int64)
                for term, q in zip(items.terms[k], items.counts[k], strict=True):
                    for places, gains in own.get(term, ()):
                        sums[places] += q * weights[term] * (gains - rest[term])
                near = np.flatnonzero(sums >= floor)
                if len(near):
                    out.append((k, None if len(near) > LEFT * BLOCK else near.astype(np.int32)))
            return pa.table({"item": pa.array([k for k, _ in out], pa.int32()), "block": pa.array([block] * len(out), pa.int64()), "places": pa.array([x for _, x in out], pa.list_(pa.int32()))})

        return self.tiers(tier, list(floors)).groupBy("block").applyInArrow(run, "item int, block long, places array<int>")

    def scored(self, pairs: DataFrame) -> DataFrame:
        """``(item, doc_id, score)`` of pairs (item, block, place), from all the document's terms."""
        shared, documents, length = self.shared, self.levels.documents, self.levels.length
        few = pairs.count() <= BROADCAST_ROWS
        rows = self.forward.join(F.broadcast(pairs) if few else pairs, ["block", "place"])
        kind = self.forward.schema["doc_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, weights, _ = shared.value
            by_item: dict[int, np.ndarray] = {}
            for batch in batches:
                rows, term, impact = flat(batch, documents, length)
                ends = np.searchsorted(rows, np.arange(batch.num_rows + 1))
                scores = np.zeros(batch.num_rows, dtype=np.int64)
                for r, k in enumerate(batch.column("item").to_pylist()):
                    if k not in by_item:
                        by_item = {k: np.zeros(len(weights), dtype=np.int64)}  # one at a time, as long as the vocabulary
                        by_item[k][items.terms[k]] = items.counts[k] * weights[items.terms[k]]
                    scores[r] = (by_item[k][term[ends[r] : ends[r + 1]]] * impact[ends[r] : ends[r + 1]]).sum()
                yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("doc_id"), pa.array(scores)], ["item", "doc_id", "score"])

        return rows.select("item", "doc_id", "n", "terms", "tfs").mapInArrow(run, f"item int, doc_id {kind}, score long")

    def answers(self) -> tuple[DataFrame | None, dict[int, int]]:
        """``(item, doc_id, score)`` with at least the best TOP of each item, and by tier how many items were proven there."""
        found, proven, todo = [], {}, list(range(len(self.items.keys)))
        for tier in range(len(SHARES) + 1):
            if not todo or self.postings is None:
                break
            best = materialize(self.scored(materialize(self.best(tier, todo), "best")), "scored")
            if tier == len(SHARES):
                found.append(best)
                proven[tier] = len(todo)
                break
            ranked = best.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))).filter(F.col("r") <= TOP)
            low = {r["item"]: r["low"] for r in ranked.groupBy("item").agg(F.min("score").alias("low"), F.count("*").alias("n")).filter(F.col("n") == TOP).collect()}  # one row for each item
            rest = {k: int((self.items.counts[k] * self.levels.weights[self.items.terms[k]] * self.levels.rests[tier][self.items.terms[k]]).sum()) for k in low}
            floors = {k: max(x, 1) for k, x in low.items() if rest[k] < x}  # else documents without any posting here may win
            if floors:
                rivals = materialize(self.rivals(tier, floors), "rivals")
                lost = {r["item"] for r in rivals.filter(F.col("places").isNull()).select("item").distinct().collect()}
                done = [k for k in floors if k not in lost]
                if done:
                    own = rivals.join(F.broadcast(self.spark.createDataFrame([(k,) for k in done], "item int")), "item", "left_semi")
                    found.append(materialize(self.scored(materialize(own.select("item", "block", F.explode("places").alias("place")), "pairs")), "scored"))
                    proven[tier] = len(done)
                    todo = [k for k in todo if k not in set(done)]
        out = None
        for x in found:
            out = x if out is None else out.unionByName(x)
        return out, proven


def search(items: DataFrame, docs: DataFrame, item_col: str = "item_id", query_col: str = "text", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the TOP documents of each item by score above 0, equal scores by id, null last.

    Each row of items is an item and each row of docs a document, repeated rows
    and ids included: of equal items each has its own answer. Null and termless
    texts match nothing and don't count as documents; empty tables give no rows.
    """
    spark = docs.sparkSession
    keyed = materialize(items.select(named(item_col).alias("item_id"), named(query_col).alias("t")).withColumn("key", F.monotonically_increasing_id()), "items")
    terms = materialize(item_terms(keyed, "key", "t"), "item_terms")
    passes = max(1, -(-terms.count() // MAX_TERMS))
    kinds = f"item_id {keyed.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema[id_col].dataType.simpleString()}, score long"
    out = spark.createDataFrame([], kinds)
    for k in range(passes):
        part = terms.filter(F.pmod(F.xxhash64("key"), F.lit(passes)) == k).toArrow().combine_chunks()  # about MAX_TERMS rows
        if not part.num_rows:
            continue
        own = Items(part["key"].to_numpy(), part["term"].combine_chunks().cast(pa.large_binary()), part["q"].to_numpy())
        found, _ = Search(forward_index(docs, own.vocabulary, id_col, text_col), own).answers()
        if found is None:
            continue
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        best = found.filter("score > 0").withColumn("rank", rank).filter(F.col("rank") <= TOP)
        keys = spark.createDataFrame(pa.table({"item": pa.array(np.arange(len(own.keys), dtype=np.int32)), "key": pa.array(own.keys)}))
        names = keyed.select("key", "item_id").join(F.broadcast(keys), "key")
        out = out.unionByName(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out


def op11_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item; nulls, repeated rows and empty tables as in ``search``."""
    return search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))
