"""Texts with very many spans, and very long ones: results by brute force, time in proportion."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from marram.llm import langid, privacy, secrets, spans

from test_corpus_queries import AWKWARD
from test_language_blocks import predicted
from test_secret_spans import ADDED


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 129, 5000])
def test_running_totals(spark, n):
    rng = random.Random(n)
    values = [rng.randrange(-9, 10) for _ in range(n)]
    df = spark.createDataFrame([(values,)], "v array<int>")
    got = df.select(spans.running(F.col("v"), lambda a, b: a + b, F.lit(0)).alias("s"), spans.running(F.col("v"), F.greatest, F.lit(None).cast("int")).alias("m")).first()
    assert got.s == [sum(values[:k]) for k in range(n + 1)]
    assert got.m == [max(values[:k], default=None) for k in range(n + 1)]


def test_pieces(spark):
    text = "".join(random.Random(1).choice("ab\n\U0001f600é") for _ in range(5000))
    places = [(0, 0), (0, 5000), (1023, 1025), (1024, 2048), (10, 10), (4999, 5000), (2048, 2049), (700, 4200)]
    df = spark.createDataFrame([(text, a, b) for a, b in places], "t string, a int, b int")
    got = df.select(spans.cut(spans.pieces_of(F.col("t")), F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [text[a:b] for a, b in places]


def test_apart(spark):
    rng = random.Random(5)
    own = sorted((a, a + rng.randrange(1, 6)) for a in rng.sample(range(3000), 300))
    rest = sorted((a, a + rng.randrange(1, 40)) for a in rng.sample(range(3000), 60))
    kind = "array<struct<start:int,end:int,match:string>>"
    df = spark.createDataFrame([([(*x, "m") for x in own], [(*x, "o") for x in rest])], f"own {kind}, rest {kind}")
    got = df.select(spans.apart(F.col("own"), F.col("rest")).alias("s")).first().s
    assert [(x.start, x.end) for x in got] == [(a, b) for a, b in own if not any(a < d and c < b for c, d in rest)]


def many_addresses(n: int) -> str:
    return " ".join(f"10.{k % 250}.{k // 250 % 250}.{k % 7} w{chr(97 + k % 26) * (k // 26 % 9 + 1)}" for k in range(n))


def test_many_spans(spark):
    def run(n):
        df = spark.createDataFrame([(1, many_addresses(n)), (2, "other words"), (3, "more of them")], "doc_id long, text string")
        began = time.perf_counter()
        row = privacy.sanitise(df, columns=["doc_id"]).filter("doc_id = 1").first()
        return row, time.perf_counter() - began

    run(10)
    row, short = run(20_000)
    text = many_addresses(20_000)
    want = [(m.start(), m.end()) for m in re.finditer(r"[0-9]+(?:\.[0-9]+){3}", text)]
    assert [(x.start, x.end) for x in row.spans if x.kind == "ip"] == want
    assert sum(x.kind == "reveal" for x in row.spans) == 20_000
    assert row.sanitised == " ".join("[IP] " for _ in range(20_000))
    assert run(40_000)[1] < 3 * short + 4


def test_runs_of_token_heads(spark):
    texts = ["eyJ" * 50_000, "eyJ" * 20 + "." + "eyJ" * 20 + "." + "x" * 12 + " tail", "a-eyJ" + "b" * 9 + "eyJ.cccccccccccc.dddddddddddd", "eyJshort.eyJ" + "q" * 10 + "." + "r" * 10 + "." + "s" * 10 + ".eyJ" + "t" * 10, "éeyJ" + "u" * 10 + "." + "v" * 11 + "." + "w" * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: [(x.start, x.end, x.match) for x in r.spans if x.kind == "jwt"] for r in secrets.scan_secrets(df).collect()}
    assert time.perf_counter() - began < 30
    for k, text in enumerate(texts[1:], 1):
        assert got[k] == [(m.start(), m.end(), m.group()) for m in re.finditer(ADDED["jwt"], text)]
    assert got[0] == []


def test_language_by_runs(spark, monkeypatch):
    monkeypatch.setattr(langid, "CHUNK", 50)
    monkeypatch.setattr(langid, "HELD_SCORES", 1)
    docs = [(k, t, ["en", "fr", None][k % 3]) for k, (_, t) in enumerate(AWKWARD)] + [(99, "le très long texte " * 300 + "İx", "fr"), (100, "the very long text " * 300, "en")]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.predict(table, langid.fit(table)).collect()}
    for (i, _, _), (label, score) in zip(docs, predicted([t for _, t, _ in docs], [(t, x) for _, t, x in docs]), strict=True):
        assert got[i]["lang_pred"] == label and abs(got[i]["score"] - score) < 1e-3
    whole = langid.text_buckets(["abc déf " * 40])[0]
    assert np.array_equal(np.concatenate(list(langid.long_buckets("abc déf " * 40, 7))), whole)
