"""Language identification: multinomial naive Bayes over hashed character n-grams.

Spark counts hashed n-grams by label over all training rows; the matrix of log
probabilities has labels x BUCKETS entries whatever the input's size, and is
broadcast for BLOCK labels at a time. Scoring sums matrix rows for a batch of
texts in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.session import materialize

from .common import bounded_runs, fields_of, id_remainder, named, struct_of, table

#: n-gram lengths, in code points.
ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
#: Added to each count.
SMOOTHING = 0.5
#: Labels of one broadcast matrix; more labels are scored in several passes.
BLOCK = 250
#: Labels whose counts a task holds before it emits them.
HELD_LABELS = 64
#: Characters that are counted or scored at a time.
CHUNK = 1 << 18
#: Matrix entries that are summed at a time: n-grams times labels.
HELD_SCORES = 1 << 22
UNKNOWN = "und"
#: Standard deviations below its label's training texts at which a text isn't taken to be of that language.
FAR = 4.0


def framed_text(text: str) -> str:
    return f" {text.lower()} "


def text_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts (uint32) and where each text's begin.

    The texts are lower-cased and framed by blanks; each text's n-grams of all
    orders stand together. An n-gram never crosses into a neighbour.
    """
    return framed_buckets([framed_text(x) for x in texts])


def long_buckets(text: str, size: int) -> Iterator[np.ndarray]:
    """The rows of ``text_buckets`` of one text, at most ``size`` at a time: each run sees as much of the next as its n-grams reach over."""
    framed = framed_text(text)
    for a in range(0, len(framed), size):
        yield framed_buckets([framed[a : a + size + max(ORDERS) - 1]])[0][:size]


def framed_buckets(framed: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``text_buckets`` of texts that are lower-cased and framed."""
    points = np.frombuffer("".join(framed).encode("utf-32-le"), dtype="<u4")
    lengths = np.array([len(x) for x in framed])
    ends = np.cumsum(lengths)
    room = np.repeat(ends, lengths) - np.arange(len(points))
    rows, mixed = [], np.zeros(len(points), dtype=np.uint32)
    for order in range(1, max(ORDERS) + 1):
        shifted = np.zeros(len(points), dtype=np.uint32)
        shifted[: len(points) - order + 1] = points[order - 1 :]
        mixed = (mixed ^ shifted) * np.uint32(0x9E3779B1) + np.uint32(order)
        if order in ORDERS:
            spread = mixed ^ (mixed >> np.uint32(15))
            rows.append(np.where(room >= order, (spread * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKETS.bit_length() + 1), BUCKETS))
    found = np.stack(rows, axis=1)
    return found, ends - lengths


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def count_ngrams(df: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """``(label, bucket, n)`` over all rows; a task emits one row for each pair it has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, labels = batch.column(0), batch.column(1).to_pylist()
            by_label: dict[str, list[int]] = {}
            for i, label in enumerate(labels):
                by_label.setdefault(label, []).append(i)
            for label, places in by_label.items():
                if label not in totals and len(totals) >= HELD_LABELS:
                    yield from emitted(totals)
                    totals = {}
                own = texts.take(pa.array(places)).to_pylist()
                total = totals.setdefault(label, np.zeros(BUCKETS + 1, dtype=np.int64))
                for i, j in bounded_runs([len(x) for x in own], CHUNK):
                    for grams in [text_buckets(own[i:j])[0]] if j - i > 1 else long_buckets(own[i], CHUNK):
                        total += np.bincount(grams.ravel(), minlength=BUCKETS + 1)
        yield from emitted(totals)

    def emitted(totals: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for label, total in totals.items():
            hit = np.flatnonzero(total[:BUCKETS])
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(hit), pa.string()), pa.array(hit.astype(np.int32)), pa.array(total[hit])], ["label", "bucket", "n"])

    rows = df.select(named(text_col).alias("t"), named(label_col).alias("label")).dropna()
    return rows.mapInArrow(run, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Labels in order, each with its log prior and its smoothed number of n-grams, and the counts table that the matrix is made of."""

    def __init__(self, labels: list[str], priors: np.ndarray, weights: np.ndarray, counts: DataFrame):
        self.labels, self.priors, self.weights, self.counts = labels, priors, weights, counts

    def blocks(self) -> list[range]:
        return [range(k, min(k + BLOCK, len(self.labels))) for k in range(0, len(self.labels), BLOCK)]

    def matrix(self, block: range) -> np.ndarray:
        """float32 (BUCKETS + 1, labels of the block) of log probabilities; the last row is zero, for places that hold no n-gram."""
        labels = self.labels[block.start : block.stop]
        place = {x: k for k, x in enumerate(labels)}
        found = self.counts.filter(F.col("label").between(labels[0], labels[-1])).toArrow()  # at most BUCKETS rows for each label of the block
        out = np.full((BUCKETS + 1, len(labels)), SMOOTHING, dtype=np.float32)
        out[found.column("bucket").to_numpy(), [place[x] for x in found.column("label").to_pylist()]] += found.column("n").to_numpy()
        out = np.log(out / self.weights[block.start : block.stop].astype(np.float32))
        out[BUCKETS] = 0
        return out


def fit(df: DataFrame, text_col: str = "text", label_col: str = "lang") -> Model:
    """The model of all rows; those with a null text or label teach nothing.

    A label's prior is its share of the training rows.
    """
    counts = materialize(count_ngrams(df, text_col, label_col), "ngrams")
    rows = df.select(named(text_col).alias("t"), named(label_col).alias("label")).dropna().groupBy("label").agg(F.count("*").alias("rows"))
    sums = counts.groupBy("label").agg(F.sum("n").alias("n")).join(rows, "label").orderBy("label").collect()  # one row for each label
    total = sum(r["rows"] for r in sums)
    priors = np.log(np.array([r["rows"] / total for r in sums]))
    weights = np.array([r["n"] + SMOOTHING * BUCKETS for r in sums], dtype=np.float64)
    return Model([r["label"] for r in sums], priors, weights, counts)


def typical_fit(df: DataFrame, model: Model, text_col: str = "text", label_col: str = "lang") -> np.ndarray:
    """By label (labels, 3): mean and variance of its training texts' fit, and the mean variance inside one.

    A text's fit is the mean log probability of its n-grams for its own label,
    the text's own counts taken out of that label's.
    """
    labels, weights = model.labels, model.weights
    found = np.zeros((len(labels), 3))
    for block in model.blocks():
        shared = df.sparkSession.sparkContext.broadcast(model.matrix(block))
        place = {labels[k]: k for k in block}
        rows = df.select(named(text_col).alias("t"), named(label_col).alias("label")).dropna().filter(F.col("label").between(labels[block.start], labels[block.stop - 1]))
        out = rows.mapInArrow(fits_of(shared, place, weights, block), "k int, n double, x double, xx double, v double").groupBy("k").agg(*(F.sum(c).alias(c) for c in ("n", "x", "xx", "v")))
        for r in out.collect():  # one row for each label
            n = max(r["n"], 1.0)
            found[r["k"]] = r["x"] / n, max(r["xx"] / n - (r["x"] / n) ** 2, 0.0), r["v"] / n
    return found


def fits_of(shared, place: dict[str, int], weights: np.ndarray, block: range):
    """A function of batches (text, label) that sums up the fits of each label of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, chances = shared.value, {}
        sums = np.zeros((len(block), 4))
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not has_letter(text):
                    continue
                k = place[label]
                if k not in chances:
                    chances[k] = np.exp(matrix[:BUCKETS, k - block.start].astype(np.float64))
                weight = weights[k]
                own = np.zeros(BUCKETS + 1, dtype=np.int64)
                for grams in long_buckets(text, CHUNK):
                    own += np.bincount(grams.ravel(), minlength=BUCKETS + 1)
                hit = np.flatnonzero(own[:BUCKETS])
                n = own[hit]
                logs = np.log(np.maximum(chances[k][hit] * weight - n, SMOOTHING) / (weight - n.sum()))
                mean = (logs * n).sum() / n.sum()
                sums[k - block.start] += 1, mean, mean * mean, ((logs - mean) ** 2 * n).sum() / n.sum()
        yield pa.RecordBatch.from_arrays([pa.array(list(block), pa.int32()), *(pa.array(x) for x in sums.T)], ["k", "n", "x", "xx", "v"])

    return run


def scores_of(shared, labels: list[str], priors: np.ndarray, carried: int, typical: np.ndarray | None):
    """A function of batches (c0, ..., text, best, top, rest, near) that takes one block of labels into account.

    best is the best label so far, top its log posterior without the common
    scale, rest the log of the sum of all labels' so far, near whether the text
    fits its best label. Null best: none so far, or a text without a letter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = shared.value
        room = max(1024, min(CHUNK, HELD_SCORES // matrix.shape[1]))
        for batch in batches:
            texts = batch.column(carried).to_pylist()
            for i, j in bounded_runs([len(x or "") for x in texts], room):
                cut = batch.slice(i, j - i)
                best, top, rest, near = (cut.column(carried + k).to_pylist() for k in range(1, 5))
                real = [k for k in range(i, j) if texts[k] is not None and has_letter(texts[k])]
                if real:
                    sums, n = np.tile(priors, (len(real), 1)), np.zeros(len(real), dtype=np.int64)
                    runs = [text_buckets([texts[k] for k in real])] if len(real) > 1 else ((x, [0]) for x in long_buckets(texts[real[0]], room))
                    for grams, starts in runs:
                        n += np.add.reduceat((grams != BUCKETS).sum(axis=1), starts)
                        for column in range(grams.shape[1]):
                            sums += np.add.reduceat(matrix[grams[:, column]], starts, axis=0, dtype=np.float64)
                    first = sums.argmax(axis=1)
                    most = sums.max(axis=1)
                    whole = most + np.log(np.exp(sums - most[:, None]).sum(axis=1))
                    fits = np.ones(len(real), dtype=bool)
                    if typical is not None:
                        mean, between, inside = typical[first].T
                        fits = (most - priors[first]) / n >= mean - FAR * np.sqrt(between + inside / n)
                    for k, b, m, w, f in zip(real, first, most, whole, fits, strict=True):
                        k -= i
                        if best[k] is None or m > top[k]:
                            best[k], top[k], near[k] = labels[b], float(m), bool(f)
                        rest[k] = float(w) if rest[k] is None else float(np.logaddexp(rest[k], w))
                made = [pa.array(best, pa.string()), pa.array(top, pa.float64()), pa.array(rest, pa.float64()), pa.array(near, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*cut.columns[: carried + 1], *made], [*(f"c{k}" for k in range(carried)), "t", "best", "top", "rest", "near"])

    return run


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", passed: list[str] | None = None, typical: np.ndarray | None = None) -> DataFrame:
    """``(id, lang_pred, score)`` of every row, or the columns ``passed`` instead of the id.

    With ``typical``, the result of ``typical_fit``, a text whose fit is more
    than FAR standard deviations below its predicted label's gives ``und`` and 0
    too; the variance is that between training texts plus the text's own, by
    its length.

    score is the posterior probability of the predicted label. A null text, one
    without a letter, and any text where nothing was learned give ``und`` and 0.
    Ties go to the first label in order. Labels are scored BLOCK at a time, each
    block with a matrix of its own. Input columns named lang_pred or score are
    replaced.
    """
    names = [c for c in (passed or [id_col]) if c.lower() not in ("lang_pred", "score")]
    keep = [c for c in names if c != text_col]  # the text goes to the workers once
    out = df.select(*(named(c).alias(f"c{k}") for k, c in enumerate(keep)), named(text_col).alias("t")).selectExpr("*", "CAST(NULL AS string) AS best", "CAST(NULL AS double) AS top", "CAST(NULL AS double) AS rest", "CAST(NULL AS boolean) AS near")
    schema = out.schema
    for place, block in enumerate(model.blocks()):
        shared = df.sparkSession.sparkContext.broadcast(model.matrix(block))
        own = slice(block.start, block.stop)
        # One matrix at a time is held: each further block reads what the one before has written.
        out = materialize(out, "scored") if place else out
        out = out.mapInArrow(scores_of(shared, model.labels[own], model.priors[own], len(keep), None if typical is None else typical[own]), schema)
    found = F.coalesce(F.col("near"), F.lit(False))
    return out.select(*(F.col("t" if c == text_col else f"c{keep.index(c)}").alias(c) for c in names), F.when(found, F.col("best")).otherwise(UNKNOWN).alias("lang_pred"), F.when(found, F.least(F.exp(F.col("top") - F.col("rest")), F.lit(1.0))).otherwise(0.0).alias("score"))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that teach nothing: crc32 of the id mod 3 is 1; a null id isn't held out."""
    return F.coalesce(id_remainder(F.col(id_col), 3) == 1, F.lit(False))


def op10_language(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out.

    Null, empty and letterless texts give und and 0; repeated rows keep their
    rows; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, fit(docs.filter(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def stage_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of the learned ones, with their columns; all that have a letter where none was learned.

    Null and empty texts and those without a letter go; repeated rows stay
    repeated; null labels teach nothing; an empty table stays empty.
    """
    training = docs.filter(~held_out())
    model = fit(training)
    if not model.labels:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    own = "text" if "text" in docs.columns else next(c for c in docs.columns if c.lower() == "text")
    others = [c for c in docs.columns if c != own]
    inner = docs.select(struct_of(others).alias("row"), named(own).alias("text"))
    out = predict(inner, model, text_col="text", passed=["row", "text"], typical=typical_fit(training, model))
    return out.filter(F.col("lang_pred") != UNKNOWN).select(*fields_of("row", others), F.col("text").alias(own)).select(*map(named, docs.columns))
