"""The pipeline, from documents to packed pieces, against plain Python."""

import math
import statistics
import zlib
from collections import Counter, defaultdict

import regex

import corpus_pipeline
from marram.session import materialize
from marram.llm import langid, quality

from test_corpus_queries import AWKWARD, BASE, WORD, as_bag, packed, tokenizer
from test_privacy_terms import disclosing, wanted_spans

PROSE = "the quick harbour master {} wrote to {} about the {} barges that carry slate and lime across the northern sound every {} until the ice came"
PLANTED = [
    PROSE.format("Zorblax", "ann@quay.example", "seven", "Monday"), PROSE.format("and", "ann@quay.example", "heavy zorblax", "spring day") + " when Zorblax sings",
    "Some other note that names ann@quay.example beside zorblax, with words enough to be kept by all of the rules that count them",
    "A much longer letter mentions zorblax alone, in plain prose that has nothing else of interest to any reader who looks for numbers",
]


def measured(text: str) -> dict:
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    n, chars = len(words), sum(map(len, words))
    covered = {k + i for k, w in enumerate(windows) if often[w] > 1 for i in range(5)}
    mean = chars / max(n, 1)
    return {
        "base": n < 10 or 100 * len(covered) > 20 * n,
        "symbols": sum(text.count(c) for c in "#*$%&|<>") > quality.SOFT_SYMBOLS * max(n, 1),
        "lines": len(lines) - len(set(lines)) > quality.SOFT_DUP_LINES * max(len(lines), 1),
        "length": not quality.SOFT_WORD_LENGTH[0] <= mean <= quality.SOFT_WORD_LENGTH[1],
    }


def kept_by_quality(docs: list[dict]) -> list[bool]:
    fails = [measured(d["text"] or "") for d in docs]
    n = Counter(d["source"] for d in docs)
    bad = set()
    for rule in quality.RULES:
        failed = Counter(d["source"] for d, f in zip(docs, fails, strict=True) if f[rule])
        rates = [failed[h] / n[h] for h in n]
        mean = sum(failed.values()) / len(docs)
        spread = mean * (1 - mean)
        real = (statistics.variance(rates) if len(rates) > 1 else 0.0) - spread * statistics.fmean(1 / x for x in n.values())
        weight = max(spread / real - 1, 10.0) if real > spread / (quality.MAX_PRIOR + 1) else quality.MAX_PRIOR
        for h in n:
            shrunk = (failed[h] + mean * weight) / (n[h] + weight)
            deviation = math.sqrt(shrunk * (1 - shrunk) / (n[h] + weight + 1))
            if shrunk > mean and (deviation == 0 or (shrunk - mean) / deviation > 1.645):
                bad.add((h, rule))
    return [not f["base"] and not any(f[r] and (d["source"], r) in bad for r in quality.RULES) for d, f in zip(docs, fails, strict=True)]


def shingles(text: str) -> set:
    words = [w.lower() for w in WORD.findall(text)]
    return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))}


def one_of_each(docs: list[dict]) -> list[dict]:
    sets = [shingles(d["text"]) for d in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both / (len(sets[i]) + len(sets[j]) - both) >= 0.8 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    best: dict[int, dict] = {}
    for d, g in zip(docs, group, strict=True):
        rank = lambda x: (x["doc_id"] is None, x["doc_id"] or 0)
        best[g] = min(best.get(g, d), d, key=rank)
    return list(best.values())


def sanitised(texts: list[str]) -> tuple[list[str], Counter]:
    """Masked texts, and what was put in place of terms."""
    out, used = [], Counter()
    for t, found in zip(texts, disclosing(texts), strict=True):
        marks = [(m.start(), m.end(), f"[{kind.upper()}]") for kind, (pattern, good) in BASE.items() for m in regex.finditer(pattern, t) if good(m)]
        order = {f"[{kind.upper()}]": k for k, kind in enumerate(BASE)}
        for start, end, kind in wanted_spans(t, found):
            form = "[ACRONYM]" if regex.fullmatch(r"\p{Lu}{2,}", t[start:end]) else "[NAME]" if regex.match(r"\p{Lu}", t[start:end]) else "[WORD]"
            marks.append((start, end, "" if kind == "reveal" else form))
            used[marks[-1][2]] += 1
        at, made = 0, ""
        for a, b, label in sorted(marks, key=lambda x: (x[0], order.get(x[2], 9))):
            if a >= at:
                made += t[at:a] + label
            at = max(at, b)
        out.append(made + t[at:])
    return out, used


def test_pipeline_equals_plain_python(spark, small, tmp_path):
    docs = [r.asDict() for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    docs += [{"doc_id": None if i is None else 10**6 + i, "text": t, "lang": None, "source": None, "n_chars": None} for i, t in AWKWARD + AWKWARD[6:8]]
    docs += [{"doc_id": 2 * 10**6 + k, "text": t, "lang": "en", "source": "planted", "n_chars": len(t)} for k, t in enumerate(PLANTED)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([tuple(d.values()) for d in docs], schema).write.parquet(f"{tmp_path}/documents.parquet")
    kept = [d for d, good in zip(docs, kept_by_quality(docs), strict=True) if good]
    # The language stage has a test of its own; here it tells what it keeps of these documents.
    table = spark.createDataFrame([tuple(d.values()) for d in kept], schema)
    kept = one_of_each([r.asDict() for r in langid.stage_language(spark, table, "").collect()])
    texts, used = sanitised([d["text"] for d in kept])
    assert used[""] and used["[WORD]"] and used["[NAME]"] and len(kept) > 50
    want, coder = [], tokenizer()
    for d, t in zip(kept, texts, strict=True):
        ids = [*coder.encode(t, add_special_tokens=False).ids, 0]
        starts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048)]
        want += [(d["doc_id"], p, a, b - a, zlib.crc32(packed(ids[a:b]))) for p, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True))]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert as_bag((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == as_bag(want)
    ends: dict[int, int] = defaultdict(int)
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 2048


def test_stages_keep_columns_and_empty_tables(spark, small):
    odd = ["doc_id", "text", "lang", "source", "n_chars", "spans", "kept", "fp", "a.b", "n_words", "t", "row", "x`y", "uid"]
    extra = ["1 AS spans", "2L AS kept", "'x' AS fp", "doc_id AS `a.b`", "'mine' AS n_words", "3 AS t", "4 AS row", "5 AS `x``y`", "6 AS uid"]
    for limit in (0, 60):
        docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").limit(limit).selectExpr("*", *extra)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialize(stage(spark, docs, small), name)
            assert docs.columns == odd
            rows = docs.collect()
            assert all(r["a.b"] == r["doc_id"] and r["n_words"] == "mine" and r["kept"] == 2 and r["row"] == 4 and r["x`y"] == 5 and r["uid"] == 6 for r in rows)
            assert len(rows) > limit // 2 or not limit
        assert bool(corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()) == bool(limit)


def test_host_verdicts(spark, small):
    docs = [r.asDict() for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = quality.op7_quality(spark, small).select("doc_id", "kept").collect()
    assert as_bag(map(tuple, got)) == as_bag((d["doc_id"], k) for d, k in zip(docs, kept_by_quality(docs), strict=True))


def test_bad_hosts_lose_failing_documents_only(spark, tmp_path):
    clean = "every plain sentence of this text has quite ordinary words and nothing that would count against it in any rule number {}"
    docs = [{"doc_id": k, "text": clean.format(k) + (" #### ####" if k % 20 == 3 or k % 10 != 3 and k % 37 == 1 else ""), "source": f"h{k % 10}"} for k in range(1000)]
    docs += [{"doc_id": 5000, "text": clean.format("x") + " #### ####", "source": None}]
    spark.createDataFrame([tuple(d.values()) for d in docs], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["kept"] for r in quality.op7_quality(spark, str(tmp_path)).collect()}
    assert got == {d["doc_id"]: k for d, k in zip(docs, kept_by_quality(docs), strict=True)}
    dropped = [k for k, kept in got.items() if not kept]
    assert sorted(dropped) == [k for k in range(1000) if k % 20 == 3]


def test_runs_stand_side_by_side(spark, small):
    """A second run leaves the first one's result and the session's settings alone."""
    keys = list(corpus_pipeline.BATCHES)
    before = [spark.conf.get(k, None) for k in keys]
    one = corpus_pipeline.run(spark, small)
    n = one.count()
    two = corpus_pipeline.run(spark, small)
    assert n and as_bag(map(tuple, one.collect())) == as_bag(map(tuple, two.collect()))
    assert [spark.conf.get(k, None) for k in keys] == before
