"""All spans of the secret scan, added rules included, against plain Python."""

import re

from marram.llm import secrets
from test_corpus_queries import AWKWARD, SECRET, as_bag

ADDED = {
    "github": r"gh[pousr]_[A-Za-z0-9]{36,}", "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}", "google": r"AIza[A-Za-z0-9_-]{35}", "stripe": r"[sr]k_live_[A-Za-z0-9]{16,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", "pem": r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----",
}
KEYS = [
    "ghp_" + "aB3" * 12, "gho_" + "x" * 35, "xoxb-12345-67890-abc", "xoxz-12345-67890", "AIza" + "Q_-7x" * 7, "sk_live_" + "9z" * 8, "rk_live_" + "9z" * 7,
    "eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.c2lnbmF0dXJl", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "-----BEGIN rsa PRIVATE KEY-----",
]


def test_spans_of_all_rules(spark, small, tmp_path):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + AWKWARD
    docs += [(9000 + k, f"{pad}{key} \U0001f600 {key}{key} {key.upper()}") for k, key in enumerate(KEYS) for pad in ("", "token: ", "é")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rules = SECRET | {k: (p, lambda m: True) for k, p in ADDED.items()}
    want = []
    for i, t in docs:
        own = [(m.start(), k, kind, m.end()) for k, (kind, (pattern, good)) in enumerate(rules.items()) for m in re.finditer(pattern, t or "") if good(m)]
        want.append((i, ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(own))))
    assert {x.split(":")[0] for _, s in want for x in s.split(",") if x} == set(rules)
    got = secrets.op9_secrets(spark, str(tmp_path)).select("doc_id", "spans").collect()
    assert as_bag(map(tuple, got)) == as_bag(want)
