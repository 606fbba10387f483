"""Subword pieces by a unigram vocabulary: reading the vocabulary, and the best way to cut a text into its pieces."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands for a blank, ids of begin, end and an unknown character, and what such a character costs more than the least likely piece.
BLANK, BEGIN, END, UNKNOWN, PENALTY = "▁", 0, 2, 3, 10.0
#: Pieces that a vocabulary may have, as tasks hold it.
PIECES = 1 << 20
WORDED = "struct<model:struct<vocab:array<array<string>>>>"


def vocabulary(df: DataFrame, json_col: str) -> DataFrame:
    """``(id, piece, score)`` of a tokenizer's JSON description: pieces by their place, of equal ones the first, empty ones left out."""
    found = df.select(F.posexplode(F.from_json(json_col, WORDED)["model"]["vocab"]).alias("id", "x")).select("id", F.get("x", F.lit(0)).alias("piece"), F.get("x", F.lit(1)).cast("float").alias("score"))
    first = found.filter("piece <> ''").groupBy("piece").agg(F.min_by(F.struct("id", "score"), "id").alias("x"))
    return first.select("x.id", "piece", "x.score")


def vocabulary_bounds(vocabulary: DataFrame) -> DataFrame:
    """One row: the longest piece's length, 1 at least, and the least score, 0 at most."""
    return vocabulary.agg(F.greatest(F.coalesce(F.max(F.length("piece")), F.lit(1)), F.lit(1)).alias("longest"), F.least(F.coalesce(F.min("score"), F.lit(0.0)), F.lit(0.0)).alias("least"))


class Trie:
    """Pieces by their characters; a node's own piece stands under the empty string."""

    def __init__(self, rows: list[tuple[int, str, float]]):
        self.root: dict = {}
        self.unknown = min((s for _, _, s in rows), default=0.0)
        self.unknown = min(self.unknown, 0.0) - PENALTY
        for number, piece, score in rows:
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = number, score

    def best(self, text: str) -> list[int]:
        """Ids of the likeliest pieces that make up the text; of equal ways the one whose last pieces are longer. A character that begins no piece is unknown."""
        reached: list[tuple[float, int, int]] = [(0.0, 0, 0)] + [(-math.inf, 0, 0)] * len(text)  # score, where the last piece begins, its id
        for at in range(len(text)):
            score = reached[at][0]
            if score == -math.inf:
                continue
            node, end, fits = self.root, at, False
            while end < len(text) and (node := node.get(text[end])) is not None:
                end += 1
                if "" in node:
                    number, own = node[""]
                    fits = True
                    if score + own > reached[end][0]:
                        reached[end] = score + own, at, number
            if not fits and score + self.unknown > reached[at + 1][0]:
                reached[at + 1] = score + self.unknown, at, UNKNOWN
        out, at = [], len(text)
        while at:
            _, begin, number = reached[at]
            out.append(number)
            at = begin
        return out[::-1]


def plain_text(text: str | None) -> str:
    """Compatibility forms composed, edges trimmed, every blank and the text's begin as BLANK."""
    return BLANK + "".join(BLANK if c.isspace() else c for c in unicodedata.normalize("NFKC", text or "").strip())


def piece_ids(df: DataFrame, id_col: str, text: Column, vocabulary: DataFrame) -> DataFrame:
    """``(id, ids)``: each text's pieces between begin and end; null and empty texts are a blank.

    ``vocabulary`` (id, piece, score) may have PIECES rows, so that it can be sent to all tasks.
    """
    if vocabulary.count() > PIECES:
        raise ValueError(f"more than {PIECES} pieces")
    shared = df.sparkSession.sparkContext.broadcast([(r["id"], r["piece"], r["score"]) for r in vocabulary.select("id", "piece", "score").collect()])
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value)
        for batch in batches:
            ids = [[BEGIN, *trie.best(plain_text(x)), END] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return df.select(F.col(id_col).alias("id"), text.alias("t")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)
