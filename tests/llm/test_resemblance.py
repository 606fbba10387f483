"""Near-duplicates of edited copies, against exact similarities of five-word shingles."""

import random

import pytest

from marram.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text: str) -> set:
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))}


def similarity(x: str, y: str) -> float:
    a, b = shingles(x), shingles(y)
    return len(a & b) / len(a | b)


def edited(words: list[str], edits: int, draw: random.Random) -> str:
    out = list(words)
    for place in draw.sample(range(0, len(out), 5), edits):
        out[place] = f"changed{draw.random()}"
    return " ".join(out)


def test_edited_copies_go(spark):
    draw = random.Random(5)
    docs, want, pairs = [], [], []
    for k in range(300):
        words = [f"w{draw.randrange(5000)}" for _ in range(300)]
        copy = edited(words, draw.randrange(1, 10), draw)
        pairs.append(similarity(" ".join(words), copy))
        docs += [(2 * k, " ".join(words)), (2 * k + 1, copy)]
        want += [2 * k] if pairs[-1] >= 0.8 else [2 * k, 2 * k + 1]
    assert sum(x >= 0.8 for x in pairs) > 100 < sum(0.8 <= x < 0.95 for x in pairs) and sum(x < 0.8 for x in pairs) > 20
    docs += [(9001, None), (9002, ""), (9003, "Just Three words"), (9004, "just three\nWORDS"), (None, "just three other words")]
    table = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], SCHEMA)
    got = [r["doc_id"] for r in simhash.stage_near_duplicates(spark, table, "").collect()]
    assert sorted(got, key=str) == sorted([*want, 9001, 9003, None], key=str)


@pytest.mark.parametrize("part", [2048, 30])
def test_copies_that_are_similar_to_some_of_their_group_only(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    draw = random.Random(11)
    base = [f"w{draw.randrange(5000)}" for _ in range(120)]
    texts = [edited(base, draw.randrange(1, 6), draw) for _ in range(150)]
    group = list(range(len(texts)))
    alike = 0
    for i, x in enumerate(texts):
        for j in range(i):
            if similarity(x, texts[j]) >= 0.8:
                alike += 1
                old, new = group[i], group[j]
                group = [min(old, new) if g in (old, new) else g for g in group]
    assert 0.05 < alike / (150 * 149 / 2) < 0.6 and 1 < len(set(group)) < 100
    table = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r["doc_id"] for r in simhash.stage_near_duplicates(spark, table, "").collect()) == sorted(set(group))
