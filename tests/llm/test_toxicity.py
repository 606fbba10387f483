"""Nearest labelled texts against brute force, accuracy on held-out rows, and awkward tables."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from marram.llm import toxicity


def index_of(rng, n_terms: int, n_rows: int) -> toxicity.Index:
    rows = []
    for k in range(n_rows):
        terms = np.sort(rng.choice(n_terms, rng.integers(0, 6), replace=False))
        rows.append((k, int(rng.random() < 0.4), terms.tolist(), rng.integers(1, 4, len(terms)).tolist()))
    return toxicity.Index(pa.array([b"t%03d" % k for k in range(n_terms)], pa.large_binary()), 1 + rng.random(n_terms), (1.5, 0.5), rows)


def test_block_max_equals_all_cosines():
    rng = np.random.default_rng(7)
    index = index_of(rng, 40, 3000)
    matrix = np.zeros((len(index.keys), 40))
    for k, (terms, counts) in enumerate(index.keys):
        matrix[k, list(terms)] = index.vector(np.array(terms), np.array(counts))
    assert len(index.keys) > 4 * toxicity.BLOCK
    texts = [np.sort(rng.choice(40, rng.integers(1, 9), replace=False)) for _ in range(200)]
    texts = [(tuple(t.tolist()), tuple(rng.integers(1, 5, len(t)).tolist())) for t in texts]
    best, near = index.nearest(texts)
    for k, (terms, counts) in enumerate(texts):
        whole = np.round(matrix[:, list(terms)] @ index.vector(np.array(terms), np.array(counts)), toxicity.DIGITS)
        order = np.lexsort((np.arange(len(whole)), -whole))[: toxicity.NEIGHBOURS]
        assert np.array_equal(near[k], whole[order]) and best[k][near[k] > 0].tolist() == order[whole[order] > 0].tolist()


def test_chances_rise_with_votes():
    rng = np.random.default_rng(3)
    index = index_of(rng, 20, 500)
    raw = rng.random(400)
    index.calibrate(raw, (rng.random(400) < raw).astype(int), np.ones(400))
    assert (np.diff(index.raw) > 0).all() and (np.diff(index.chance) >= -1e-9).all()
    low, mid, high = index.score(np.array([0.0, 0.5, 1.0]))
    assert 0 <= low <= mid <= high <= 1 and abs(mid - 0.5) < 0.25


def test_held_out_accuracy(spark, small):
    """Three of four toxic rows at least are found where their labels weren't seen; hardly a clean row is accused. Some labels contradict the texts."""
    folder = small.replace("sf0.001", "sf0.1")
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = toxicity.op12_toxicity(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    out = [r for r in rows if r.held_out and r.doc_id in toxic]
    hit = sum(r.predicted for r in out if toxic[r.doc_id])
    assert hit >= 0.75 * sum(toxic[r.doc_id] for r in out)
    assert sum(r.predicted for r in out if not toxic[r.doc_id]) <= 0.01 * len(out)
    assert all(r.evidence for r in rows if r.predicted)


PLAIN = ["the cat sat on the mat", "a day by the sea", "one more plain line of text", "numbers and names", "nothing to see here"]


@pytest.fixture(scope="module")
def planted(spark):
    docs, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        text = f"{PLAIN[k % 5]} number{k} " + ("vile grim" if bad and k % 8 else "grim vile foul" if bad else "fine kind")
        docs.append((k, text, "x"))
        labels.append((k, int(bad)))
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, "unknown words only", "x"), (None, "vile foul grim", "x"), (1003, "all quite fine and kind " * 3000 + "vile grim foul vile", "x"), (1004, "VILE!grim", "x"), (1005, "fine, kind", "x"), (1004, "VILE!grim", "x")]
    labels += [(None, 1), (3, None), (5, 7), (7, 1), (7, 0), (11, 0), (11, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_planted(planted):
    docs, labels = planted
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    assert out.columns == ["doc_id", "score", "predicted", "evidence"]
    rows = out.collect()
    assert len(rows) == docs.count()
    found = {r.doc_id: r for r in rows}
    assert all(found[k].predicted == int(k % 4 == 0) for k in range(400) if k != 7)
    assert found[None].predicted == 1 and found[1004].predicted == 1 and found[1005].predicted == 0
    assert {found[1000].score} == {found[1001].score, found[1002].score} and found[1000].predicted == 0 and found[1000].evidence == []
    assert sum(r.doc_id == 1004 for r in rows) == 2
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(e % 4 == 0 for e in found[1004].evidence)


def test_bounded_sample_still_finds(planted, monkeypatch):
    docs, labels = planted
    monkeypatch.setattr(toxicity, "LABELLED", 40)
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    found = {r.doc_id: r.predicted for r in rows}
    assert all(found[k] == int(k % 4 == 0) for k in range(400) if k != 7)


def test_nothing_learned(spark, planted):
    docs, labels = planted
    for none in (labels.limit(0), labels.filter("toxic = 0")):
        assert {(r.score, r.predicted) for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {(0.0, 0)}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, labels)).collect() == []
