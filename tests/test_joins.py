"""Containment, labels by blocks, samples, pieces and genre steps against plain Python."""

import itertools
import json
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marram.functions import pieces
from marram.operators import genres, matching, relational


@pytest.mark.parametrize("seed", [1, 2])
def test_containment_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("aab\U0001f600é ") for _ in range(n))
    values = [(rng.choice("xy"), word(rng.randrange(0, 30))) for _ in range(200)] + [("x", "aaa"), ("x", "aaa"), ("x", None), ("y", "")]
    needles = [(rng.choice("xyz"), word(rng.randrange(0, 6))) for _ in range(80)] + [("x", ""), ("x", "q"), ("y", "a" * 40), ("x", None), (None, "a")]
    left, right = spark.createDataFrame(values, "p string, v string"), spark.createDataFrame(needles, "p string, w string")
    got = matching.contained_in(left, right, "v", "w", ("p",)).collect()
    want = {(p, v, w) for (p, v), (q, w) in itertools.product(values, needles) if p is not None and p == q and v is not None and w is not None and w in v}
    assert len(got) == len(want) and {(r.p, r.v, r.w) for r in got} == want
    got = {(r.v, r.w) for r in matching.contained_in(left, right, "v", "w").collect()}
    assert got == {(v, w) for (_, v), (_, w) in itertools.product(values, needles) if v is not None and w is not None and w in v}


def test_containment_in_long_texts(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh ") for _ in range(matching.GRAM_SPAN + 100))
    cut = matching.GRAM_SPAN
    rows = [(1, long), (1, long), (2, long[: cut - 2] + "nEEdle" + long[cut:]), (3, long[: cut // 4] + "é"), (4, "nEE"), (5, "n"), (6, ""), (7, None), (8, "\U0001f600dl")]
    needles = ["nEEdle", "nEE", "Edl", "é", "zq", "dl", "\U0001f600", "", "n", None, long[cut - 5 : cut + 5], long[-9:], long[3 : cut + 9], "nEE"]
    began = time.monotonic()
    found = matching.rows_containing(spark.createDataFrame(rows, "k int, v string"), spark.createDataFrame([(x,) for x in needles], "w string"), "v", "w").select("k", "w").collect()
    assert time.monotonic() - began < 40  # substrings by their place, counted from the start each time, took minutes
    want = [(k, w) for k, v in rows if v is not None for w in dict.fromkeys(needles) if w is not None and w in v]
    assert sorted((r.k, r.w) for r in found) == sorted(want)


def test_containment_joins_digests_of_texts(spark):
    rows = spark.createDataFrame([(k, f"text {k}" * 50) for k in range(50)], "k int, v string")
    plan = matching.rows_containing(rows, rows.select(F.substring("v", 2, 6).alias("w")), "v", "w")._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join Inner" in x]
    assert any("__text" in x for x in joins) and not any(re.search(r"v#\d+ = ", x) for x in joins)


def test_containment_has_no_nested_loop(spark):
    df = spark.range(1000).select(F.concat(F.lit("value "), "id").alias("v"))
    plan = matching.contained_in(df, df.select(F.substring("v", 3, 6).alias("w"), F.lit("x").alias("p")).withColumn("w", F.col("w")), "v", "w")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and text.count("BroadcastNestedLoopJoin") <= 1  # with the one empty needle


def test_labels_by_blocks_equal_labels_in_rows(spark):
    rng = np.random.default_rng(4)
    vectors = [(k, rng.normal(size=5).round(1).tolist()) for k in range(60)] + [(60, [0.0] * 5)]
    labels = [(k, rng.normal(size=5).round(1).tolist()) for k in range(40)]
    labels += [(k + 40, v) for k, v in labels[:20]] + [(99, [0.0] * 5)]  # ties
    left, right = spark.createDataFrame(vectors, "id int, v array<double>"), spark.createDataFrame(labels, "label int, center array<double>")
    whole = sorted((r.id, r.place, r.label, round(r.score, 9)) for r in matching.nearest_labels(left, right, "id", "v", 4).collect())
    for block in (1, 7, 60):
        got = sorted((r.id, r.place, r.label, round(r.score, 9)) for r in matching.nearest_labels(left, right, "id", "v", 4, block).collect())
        assert [x[:2] for x in got] == [x[:2] for x in whole]
        assert all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(got, whole, strict=True))
        assert sum(a[2] != b[2] for a, b in zip(got, whole, strict=True)) <= 2  # of scores that differ beyond the twelfth decimal only


def test_labels_by_blocks_pass_the_driver_by(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("labels went to the driver")

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refused)
    monkeypatch.setattr(type(spark.range(1)), "toArrow", refused)
    monkeypatch.setattr(matching, "SHARE", 60 * 6 * 8)
    monkeypatch.setattr(matching, "CELLS", 90 * 6)
    rng = np.random.default_rng(5)
    rows = [(f"v{k:03}", rng.normal(size=6).tolist()) for k in range(150)]
    rows += [(f"w{k:03}", (np.array(v) * (k % 3 + 1)).tolist()) for k, (_, v) in enumerate(rows[:50])] + [("z", [0.0] * 6), ("n", None)]
    df = spark.createDataFrame(rows, "id string, v array<double>").repartition(5)
    got = sorted((r.id, r.place, r.label, round(r.score, 9)) for r in matching.nearest_labels(df, df.select(F.col("id").alias("label"), F.col("v").alias("center")), "id", "v", 3, 16, 10).collect())
    unit = {k: np.zeros(6) if v is None or not any(v) else np.array(v) / np.linalg.norm(v) for k, v in rows}
    want = [(a, place, b, round(-loss, 9)) for a in unit for place, (loss, b) in enumerate(sorted((-round(float(unit[a] @ unit[b]), 10) + 0.0, b) for b in unit)[:3])]
    assert got == sorted(want)
    assert len({x[0] for x in got}) == 202


def test_scores_are_compared_to_digits(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(5, v), (4, [x * 3 for x in v]), (3, [1.0, 2.0, 3.0 + 1e-7]), (2, [1.0, 2.0, 3.001]), (1, [0.1, 0.2, 0.3])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    for block in (2, 10):
        got = matching.nearest_labels(df, df.select(F.col("id").alias("label"), F.col("v").alias("center")), "id", "v", 4, block, 10).filter("id = 5").collect()
        assert [r.label for r in sorted(got, key=lambda r: r.place)] == [1, 3, 4, 5]


@pytest.mark.parametrize("top", [1, 3, 50])
def test_best_labels_of_blocks_in_any_order(top):
    rng = np.random.default_rng(top)
    centers = matching.unit_rows(rng.normal(size=(300, 4)).round(1).tolist())
    centers[100:200], centers[250] = centers[3], np.nan
    units = np.concatenate([centers[:280:7], np.full((1, 4), np.nan)])
    scores = np.round(units @ centers.T, 10)
    ranked = np.where(np.isnan(scores), -2, scores)
    want = [(i, int(k)) for i, x in enumerate(ranked) for k in np.lexsort((np.arange(300), -x))[:top]]
    for step, seed in itertools.product((1, 30, 300), (0, 1)):
        best = matching.Best(pa.array(range(len(units))), units, top, 10)
        for start in np.random.default_rng(seed).permutation(range(0, 300, step)).tolist():
            best.meet(pa.array(range(start, start + step)), centers[start : start + step], start)
        rows = best.rows()
        assert list(zip(rows["id"].to_pylist(), rows["label"].to_pylist(), strict=True)) == want
        assert np.allclose(rows["score"].to_numpy(), [scores[x] for x in want], atol=1e-9, equal_nan=True)


def test_samples_depend_on_the_seed_only(spark):
    df = spark.range(5000).withColumn("score", F.col("id") / 5000)
    draw = lambda d, seed: [r.id for r in relational.random_sample(d, "id", 100, seed).collect()]
    assert draw(df, 1) == draw(df.repartition(7), 1) != draw(df, 2)
    assert 1500 < np.mean(draw(df, 1)) < 3500
    band = relational.sampled_band(df, "score", 0.8, 0.88, "id", 25, 1).collect()
    assert len(band) == 25 and all(0.8 <= r.score < 0.88 for r in band)
    assert relational.random_sample(df.limit(0), "id", 5, 1).collect() == []


def every_cut(text, scores, unknown):
    """Score of the best way to cut a text, by trying all."""
    if not text:
        return 0.0
    ways = [scores[text[:k]] + every_cut(text[k:], scores, unknown) for k in range(1, len(text) + 1) if text[:k] in scores]
    return max(ways) if ways else unknown + every_cut(text[1:], scores, unknown)


def test_pieces_are_the_likeliest():
    rng = random.Random(9)
    vocabulary = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))): -float(rng.randrange(1, 30)) for _ in range(25)}
    vocabulary.pop("c", None)
    rows = [(k + 10, p, s) for k, (p, s) in enumerate(vocabulary.items())]
    trie, by_id = pieces.Trie(rows), {k: (p, s) for k, p, s in rows}
    for _ in range(150):
        text = "".join(rng.choice("abcx") for _ in range(rng.randrange(0, 10)))
        ids = trie.best(text)
        assert "".join(by_id[i][0] if i in by_id else "?" for i in ids).replace("?", "") in "".join(text) or pieces.UNKNOWN in ids
        own = sum(by_id[i][1] if i in by_id else trie.unknown for i in ids)
        assert math.isclose(own, every_cut(text, vocabulary, trie.unknown)) or pieces.UNKNOWN in ids


def test_pieces_of_texts(spark):
    blank = pieces.BLANK
    described = json.dumps({"model": {"vocab": [["<s>", 0.0], ["<pad>", 0], ["</s>", 0], ["<unk>", 0], [blank, -2.0], [blank + "ab", -3.5], ["c", -1.0], ["ab", -4.0], ["c", -9.0], ["", -1.0], ["ﬁ", -1.0], ["fi", -2.5]]}})
    vocabulary = pieces.vocabulary(spark.createDataFrame([(described,)], "j string"), "j")
    assert {(r.id, r.piece, r.score) for r in vocabulary.collect() if r.id > 3} == {(4, blank, -2.0), (5, blank + "ab", -3.5), (6, "c", -1.0), (7, "ab", -4.0), (10, "ﬁ", -1.0), (11, "fi", -2.5)}
    assert tuple(pieces.vocabulary_bounds(vocabulary).first()) == (5, -4.0)
    rows = spark.createDataFrame([(1, " abc\tab "), (2, None), (3, ""), (4, "zc"), (5, "ﬁ")], "k int, t string")
    got = {r.k: r.ids for r in pieces.piece_ids(rows, "k", F.col("t"), vocabulary).collect()}
    assert got == {1: [0, 5, 6, 5, 2], 2: [0, 4, 2], 3: [0, 4, 2], 4: [0, 4, 3, 6, 2], 5: [0, 4, 11, 2]}


def test_genre_steps(spark):
    entries = [(0, "Science Fiction", "Science Fiction", False, None), (1, "sci-fi", "Science Fiction", False, None), (2, "Роман", "Роман", False, None), (3, "novel", "Роман", False, None), (4, "novel", "Prose", False, None), (5, "space", "Space", True, 2), (6, "opera", "Opera", True, 1), (7, "oper", "Oper", True, 1), (8, "zzzz", "Z", True, None)]
    dictionary = spark.createDataFrame(entries, "ord int, variant string, canonical string, part boolean, priority int")
    values = {"Science Fiction": ("reference", ["Science Fiction"]), "SCI FI": ("variant", ["Science Fiction"]), "No-vel": ("variant", ["Prose"]), "Pоман": ("reference", ["Роман"]), "scifix": ("distance", ["Science Fiction"]), "Space OPERA x": ("part", ["Oper", "Opera", "Space OPERA x"]), "a zzzz space": ("part", ["Space", "a zzzz space"]), "Oчень странно": ("repaired", ["Очень странно"]), "unheard": None, "": None}
    got = {r.v: (r.step, sorted(r.names)) for r in genres.reference_steps(spark.createDataFrame([(v,) for v in values] + [(None,)], "v string"), dictionary).collect()}
    assert got == {k: v for k, v in values.items() if v}
    rows = spark.createDataFrame([(1, "sci-fi, Space OPERA x; abc"), (2, "abc, unheard"), (3, None), (4, "")], "k int, genre string")
    assert {r.k: r.genre for r in genres.normalise_genres(rows, dictionary, "k", "genre").collect()} == {1: "Oper, Opera, Science Fiction, Space OPERA x", 2: "abc, unheard", 3: None, 4: ""}


def test_group_tree_has_an_unset_group(spark):
    df = spark.createDataFrame([(1, ["Beta", "alpha"]), (2, ["ALPHA", "9x"]), (2, ["alpha"])], "k int, v array<string>")
    got = [(r.letter, r.value, r.caption, r.cnt) for r in relational.group_tree(df, F.col("v"), "k", lambda x: x).orderBy("letter_place", "place").collect()]
    assert got == [("<not set>", None, "<not set> [0]", 0), ("<other>", None, "<other> [1]", 1), ("<other>", "9x", "9x [1]", 1), ("A", None, "A [2]", 2), ("A", "alpha", "alpha [2]", 2), ("B", None, "B [1]", 1), ("B", "Beta", "Beta [1]", 1)]
