"""Language scores against plain Python, and more labels than one block holds."""

import math
from collections import Counter

import numpy as np

from marram.llm import langid

from test_corpus_queries import AWKWARD


def grams(text: str) -> Counter:
    out: Counter = Counter()
    framed = f" {text.lower()} "
    for i in range(len(framed)):
        mixed = 0
        for order in range(1, 4):
            if i + order > len(framed):
                break
            mixed = ((mixed ^ ord(framed[i + order - 1])) * 0x9E3779B1 + order) % (1 << 32)
            spread = mixed ^ (mixed >> 15)
            out[((spread * 0x85EBCA6B) % (1 << 32)) >> 16] += 1
    return out


def predicted(texts, training):
    rows, counts = Counter(), {}
    for t, label in training:
        if t is not None and label is not None:
            rows[label] += 1
            counts.setdefault(label, Counter()).update(grams(t))
    out = []
    for t in texts:
        if t is None or not any(map(str.isalpha, t)):
            out.append(("und", 0.0))
            continue
        own = grams(t)
        logs = {}
        for label in sorted(rows):
            n = sum(counts[label].values()) + 0.5 * 65536
            logs[label] = math.log(rows[label] / sum(rows.values())) + sum(c * math.log((counts[label][b] + 0.5) / n) for b, c in own.items())
        best = max(sorted(logs), key=lambda x: logs[x])
        out.append((best, 1 / sum(math.exp(x - logs[best]) for x in logs.values())))
    return out


def test_scores_equal_plain_python(spark, small):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    docs += [(None if i is None else 10**6 + i, t if t is None else t[:2000], None) for i, t in AWKWARD]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.fit(table)
    got = {(r["doc_id"], r["text"]): r for r in langid.predict(table, model, passed=["doc_id", "text"]).collect()}
    for (i, t, _), (label, score) in zip(docs, predicted([t for _, t, _ in docs], [(t, x) for _, t, x in docs]), strict=True):
        r = got[i, t]
        assert r["lang_pred"] == label and math.isclose(r["score"], score, rel_tol=1e-3, abs_tol=1e-6)


def test_many_labels(spark):
    rng = np.random.default_rng(3)
    names = [f"l{k:04}" for k in range(600)]
    vocabulary = {x: ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(5)] for x in names}
    rows = [(k, " ".join(vocabulary[x]), x) for k, x in enumerate(names)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(table)
    assert len(model.blocks()) == 3
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(table, model).collect()}
    assert sum(got[k] == x for k, _, x in rows) >= 595
    kept = langid.stage_language(spark, table, "").count()
    assert kept >= 300
