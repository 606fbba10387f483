"""Ranked search against plain Python, with proofs in every tier."""

import math
import re
from collections import Counter

import pyarrow as pa
import pytest

from marram.llm import lexical, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = [
    (1, None), (2, ""), (3, "..."), (4, "Alpha beta"), (5, "alpha BETA gamma"), (5, "alpha BETA gamma"), (None, "alpha beta"), (7, "Ünter über alpha2 alpha_beta"), (8, "delta " * 4000 + "alpha"),
    *((100 + k, "the alpha copy of many") for k in range(60)), *((300 + k, f"the word{k} and word{k % 7} beta") for k in range(200)), (9, "x" * 50000 + " word3"),
]
ITEMS = [(1, "alpha beta"), (2, None), (3, "!?"), (4, "word3 word3 the"), (5, "nowhere"), (6, "ÜNTER über Ünter"), (6, "copy of many"), (None, "gamma delta"), (8, "the"), (4, "word3 word3 the")]


def brute(items, docs):
    lower = {c: c + 32 for c in range(65, 91)}
    counted = [(i, Counter(TERM.findall((t or "").translate(lower)))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counted:
            score = 0
            for t in TERM.findall((text or "").translate(lower)):
                if c[t]:
                    m = 100 - 25 + (25 * sum(c.values()) * n_docs) // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
            if score:
                found.append((-score, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:20])]
    return sorted(map(repr, out))


@pytest.mark.parametrize(("shares", "left"), [((1 / 64, 1 / 8), 1 / 32), ((1 / 300, 1 / 100), 1 / 32), ((0.5, 0.9), 1.0), ((1e-9, 1e-9), 1.0)])
def test_equals_brute_force(spark, monkeypatch, shares, left):
    monkeypatch.setattr(lexical, "SHARES", shares)
    monkeypatch.setattr(lexical, "LEFT", left)
    docs = spark.createDataFrame([(i, t, 0) for i, t in DOCS], "doc_id long, text string, score int").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = lexical.search(items, docs)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(ITEMS, DOCS)


def test_every_tier_proves_some(spark, small):
    """Over the given table some items are proven before the last tier, and what is proven early equals brute force."""
    folder = small.replace("sf0.001", "sf0.01")
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    keyed = items.selectExpr("item_id AS key", "text")
    found = lexical.item_terms(keyed, "key", "text").toArrow()
    own = lexical.Items(found["key"].to_numpy(), found["term"].combine_chunks().cast(pa.large_binary()), found["q"].to_numpy())
    _, proven = lexical.Search(lexical.forward_index(docs, own.vocabulary, "doc_id", "text"), own).answers()
    assert sum(proven.values()) == items.count() and min(proven) < 2
    got = sorted(repr(tuple(r)) for r in lexical.search(items, docs).collect())
    assert got == brute([(r.item_id, r.text) for r in items.collect()], [(r.doc_id, r.text) for r in docs.collect()])


def test_several_passes(spark, monkeypatch):
    monkeypatch.setattr(lexical, "MAX_TERMS", 4)
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted(repr(tuple(r)) for r in lexical.search(items, docs).collect()) == brute(ITEMS, DOCS)


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 20])
def test_terms_of_cut_texts(chunk):
    texts = ["Ab cD", None, "", "  ", "ééé-x9", "long" * 40, "tail "]
    column = pa.array(["skipped", *texts])[1:]
    found = [(t.as_py().decode(), int(r)) for terms_, rows in terms.term_chunks(column, chunk) for t, r in zip(terms_, rows, strict=True)]
    lower = {c: c + 32 for c in range(65, 91)}
    assert found == [(t, k) for k, x in enumerate(texts) for t in TERM.findall((x or "").translate(lower))]


def test_no_documents(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(items, spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert lexical.search(items, spark.createDataFrame([(1, None), (2, "?")], "doc_id long, text string")).collect() == []
