"""Disclosing terms over whole texts, against plain Python."""

import math
import random
from collections import defaultdict

import regex

from marram.llm import privacy

from test_corpus_queries import BASE

FAR = " and then the usual words about the weather went on for very much longer than sixty characters would ever do "


def terms(text: str) -> set[str]:
    return {w.lower() for w in regex.split(r"[^\p{L}]+", text) if w}


def disclosing(texts: list[str]) -> list[dict[str, float]]:
    """For each text, its terms that disclose an identifier in it, with their shares."""
    entities, holders, own = defaultdict(set), defaultdict(set), []
    for t in texts:
        names = {(kind, regex.sub("[^0-9]", "", m.group()) if kind in ("card", "phone") else m.group().lower()) for kind, (pattern, good) in BASE.items() for m in regex.finditer(pattern, t) if good(m)}
        own.append(names)
        for name in names:
            entities[name].add(t)
        for w in terms(t):
            holders[w].add(t)
    total, out = len(set(texts)), []
    for t, names in zip(texts, own, strict=True):
        found: dict[str, float] = {}
        for name in names:
            info = math.log2(total / len(entities[name]))
            for w in terms(t):
                share = math.log2(total * len(entities[name] & holders[w]) / (len(entities[name]) * len(holders[w]))) / info if info > 0 else 0
                if share >= 0.6:
                    found[w] = max(found.get(w, 0), share)
        out.append(found)
    return out


def wanted_spans(text: str, found: dict[str, float]) -> list[tuple]:
    base = [(m.start(), m.end()) for pattern, good in BASE.values() for m in regex.finditer(pattern, text) if good(m)]
    out = []
    for m in regex.finditer(r"\p{L}+", text):
        share = found.get(m.group().lower())
        if share is not None and not any(m.start() < b and a < m.end() for a, b in base):
            out.append((m.start(), m.end(), "reveal" if share >= 0.9 else "hint"))
    return out


def test_terms_of_whole_texts(spark, small):
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    texts += ["ann@quay.example" + FAR + "Zorblax", "Zorblax wrote" + FAR + "to ann@quay.example", "lone@dock.example" + FAR + "Quibnix", "quibble", "", "only +49 30 1234567 here"]
    texts += texts[-6:-3] + [FAR]
    random.Random(3).shuffle(texts)
    rows = [(k, t) for k, t in enumerate(texts)]
    got = privacy.sanitise(spark.createDataFrame([*rows, (-1, None)], "doc_id long, text string").repartition(3), columns=["doc_id"], mask=False).collect()
    mine = {r["doc_id"]: [(x["start"], x["end"], x["kind"]) for x in r["spans"] if x["kind"] in ("reveal", "hint")] for r in got}
    want = {k: wanted_spans(t, f) for (k, t), f in zip(rows, disclosing(texts), strict=True)}
    assert mine == {**want, -1: []}
    for k, t in rows:
        for w in ("Zorblax", "Quibnix"):
            assert w not in t or any(t[a:b] == w for a, b, _ in mine[k])
