"""The suffix tree's scores against a plain-Python tree, and that its probabilities sum to one."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from marram.llm import suffix_tree

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class PlainTree:
    """The model by its definition: dictionaries, one symbol at a time."""

    def __init__(self, texts: list[str]):
        tokens = [self.words(t) for t in texts]
        count = Counter(w for x in tokens for w in x if w)
        self.alphabet = [w for w, _ in sorted(((w, n) for w, n in count.items() if len(w) <= 64 and n >= 2), key=lambda x: (-x[1], x[0]))[: suffix_tree.ALPHABET]]
        self.known = set(self.alphabet)
        self.fit_spelling({w: n for w, n in count.items() if w not in self.known})
        symbols = [self.symbols(x) for x in tokens]
        plain = Counter(s for x in symbols for s in x)
        total = sum(plain.values()) + len(self.alphabet) + 2
        self.root = {s: (plain[s] + 1) / total for s in [*self.alphabet, "rare", "end"]}
        self.next: dict[tuple, Counter] = defaultdict(Counter)
        for x in symbols:
            line = ["start"] * 3 + x
            for k in range(3, len(line)):
                for depth in (1, 2, 3):
                    self.next[tuple(line[k - depth : k])][line[k]] += 1
        self.states: set[tuple] = set()
        for context in sorted(self.next, key=len):
            own, n = self.next[context], sum(self.next[context].values())
            if n >= 2 and sum(c * math.log(self.without(context, s, n) / self.chance(context[1:], s)) for s, c in own.items()) >= 3.0:
                self.states.add(context)

    @staticmethod
    def words(text):
        return [*WORD.findall((text or "").encode().lower()), b""]

    def symbols(self, words):
        return [w if w in self.known else "rare" if w else "end" for w in words]

    def fit_spelling(self, words):
        pairs: dict[int, Counter] = defaultdict(Counter)
        for w, n in words.items():
            for a, b in zip([256, *w], [*w, 256], strict=True):
                pairs[a][b] += n
        never = {*range(9, 14), 32, *range(65, 91), 0xC0, 0xC1, *range(0xF5, 0x100)}
        plain = {b: sum(c[b] for c in pairs.values()) + 1 for b in range(257) if b not in never}
        all_ = sum(plain.values())
        self.letter = {}
        for a in range(257):
            kinds = max(len(pairs[a]), 1)
            row = {b: (pairs[a][b] + kinds * q / all_) / (sum(pairs[a].values()) + kinds) for b, q in plain.items() if (a, b) != (256, 256)}
            scale = sum(row.values()) if a == 256 else 1
            self.letter |= {(a, b): p / scale for b, p in row.items()}
        self.left = math.log10(1 - sum(10 ** self.spelled(w) for w in self.alphabet))

    def spelled(self, word):
        return sum(math.log10(self.letter[a, b]) for a, b in zip([256, *word], [*word, 256], strict=True))

    def chance(self, context, symbol):
        while context and context not in self.states:
            context = context[1:]
        if not context:
            return self.root[symbol]
        own = self.next[context]
        return (own[symbol] + len(own) * self.chance(context[1:], symbol)) / (sum(own.values()) + len(own))

    def without(self, context, symbol, n):
        """The context's chance of a symbol after one occurrence of it is taken away."""
        own = self.next[context] - Counter([symbol])
        return (own[symbol] + len(own) * self.chance(context[1:], symbol)) / (n - 1 + len(own))

    def score(self, text):
        words = self.words(text)
        line = ["start"] * 3 + self.symbols(words)
        out = sum(math.log10(self.chance(tuple(line[k - 3 : k]), line[k])) for k in range(3, len(line)))
        return out + sum(self.spelled(w) - self.left for w in words if w and w not in self.known)


def corpus(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    docs += [(10**6 + k, t) for k, t in enumerate([None, "", "  ", "la " * 3000, "Unseen" + "x" * 500, "la la la end", "the zzz " * 50, "naïve \U0001f600"])]
    return docs + docs[:2] + [(None, "a null id")]


@pytest.mark.parametrize(("unit", "long_words"), [(1 << 22, False), (1500, False), (300, True)])
def test_scores_equal_a_plain_tree(spark, small, monkeypatch, unit, long_words):
    monkeypatch.setattr(suffix_tree, "UNIT", unit)  # small units split hot contexts
    if unit < 1500:  # many chunks, whose counts are added up in several rounds
        monkeypatch.setattr(suffix_tree, "CHUNK", 2000)
        monkeypatch.setattr(suffix_tree, "FAN", 3)
        monkeypatch.setattr(suffix_tree, "BROADCAST_ROWS", 0)
    docs = corpus(spark, small)
    if long_words:  # too long to be symbols, so that training has rare words
        docs = [(i, t if t is None else re.sub(r"\b(\w*[qx]\w*)\b", lambda m: m.group(1) * 20, t)) for i, t in docs]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tree = PlainTree([t or "" for i, t in docs if not held(i)])
    assert {len(s) for s in tree.states} == {1, 2, 3}
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = suffix_tree.score_texts(table, ~suffix_tree.held_out()).collect()
    mine = sorted((str(r["doc_id"]), r["score"]) for r in got)
    want = sorted((str(i), tree.score(t)) for i, t in docs)
    for (i, a), (j, b) in zip(mine, want, strict=True):
        assert i == j and math.isclose(a, b, rel_tol=1e-9), (i, a, b)


def test_probabilities_sum_to_one(spark, small):
    docs = [r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    tree = PlainTree(docs)
    symbols = [*tree.alphabet, "rare", "end"]
    deep = [c for c in tree.states if len(c) == 3][:5]
    for context in [(), *deep, *(c[1:] for c in deep), ("rare", "the", "rare")]:
        assert math.isclose(sum(tree.chance(context, s) for s in symbols), 1.0, rel_tol=1e-9)
    logs = suffix_tree.spelling_logs(np.random.default_rng(1).integers(0, 50, (257, 257)) * (np.arange(257) % 3 == 0))
    assert np.allclose((10.0**logs).sum(axis=1), 1.0) and 10.0 ** logs[256, 256] == 0


def test_long_words_take_linear_time():
    logs = suffix_tree.spelling_logs(np.zeros((257, 257)))
    one, two = suffix_tree.spelled([b"ab" * 1000, b"ab" * 500_000], logs)
    assert two < one < 0 and math.isclose(two / one, 1_000_001 / 2001, rel_tol=0.01)
