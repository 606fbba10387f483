"""Quality rules of documents and hosts, in DataFrame operations.

Each document is measured by itself (words, symbols, repeated lines and
five-word windows). Failures are then counted by host (``source``) and each
host's rate is shrunk by a beta prior that is fitted to all hosts. A host is
condemned for a rule where its rate lies, by its posterior distribution, above
the corpus's rate with near certainty; it loses those of its documents that fail
this rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.session import materialize

from .common import SPACES, fields_of, named, split_words, struct_of, table

WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: A document fails the base rules below this many words ...
MIN_WORDS = 10
#: ... or above this percentage of words in repeated windows.
MAX_REPEAT_PERCENT = 20
#: Softer rules, which count by host: the share of symbols to words, of repeated lines to lines, and the mean word length.
SOFT_SYMBOLS, SOFT_DUP_LINES, SOFT_WORD_LENGTH = 0.1, 0.3, (2.0, 15.0)
#: A host is condemned for a rule when its posterior mean lies so many posterior standard deviations above the corpus's rate: 95 % certainty.
CERTAINTY = 1.645
#: Condemned hosts that may be broadcast; beyond, they are joined by shuffling.
BROADCAST_HOSTS = 200_000
#: Weight of the prior, in documents: its least, so that a few documents condemn no host, and its most, where hosts don't differ enough to estimate it.
MIN_PRIOR, MAX_PRIOR = 10.0, 1000.0
RULES = ("base", "symbols", "lines", "length")


def repeated_window_words(words: str, keys: str) -> Column:
    """Words inside windows that occur twice or more, from arrays in columns.

    ``keys`` holds a hash per window in order. Sorting (key, place) pairs brings
    equal windows together; a repeated window at place p covers the places up to
    the next repeated window, WINDOW at most.
    """
    return F.expr(f"""
        CASE WHEN size({keys}) < 2 OR size(array_distinct({keys})) = size({keys}) THEN 0L
        ELSE aggregate(
            array_sort(filter(
                transform(array(sort_array(transform({keys}, (k, i) -> named_struct('k', k, 'i', i)))),
                    s -> transform(s, (x, j) -> IF((j > 0 AND s[greatest(j - 1, 0)].k = x.k) OR (j < size(s) - 1 AND s[least(j + 1, size(s) - 1)].k = x.k), x.i, -1)))[0],
                p -> p >= 0)),
            named_struct('n', 0L, 'to', 0),
            (a, p) -> named_struct('n', a.n + p + {WINDOW} - greatest(p, a.to), 'to', p + {WINDOW}),
            a -> a.n) END""")


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words.

    These replace columns of the same names. A null text counts as empty.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    keep = [c for c in df.columns if c.lower() not in made]
    row = df.select(F.struct(*keep).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    row = row.select("row", "t", F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0).alias("lines"), split_words(F.col("t")).alias("w"))
    row = row.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    row = row.withColumn(
        "k",
        F.expr(f"CASE WHEN size(h) < {WINDOW} THEN array() ELSE transform(sequence(0, size(h) - {WINDOW}), i -> xxhash64({', '.join(f'h[i + {k}]' for k in range(WINDOW))})) END"),
    )
    return row.select(
        "row.*",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_window_words("w", "k").cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def soft_failures() -> dict[str, Column]:
    """Rule name to failure, over the columns of ``measure``; never null."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    mean = F.col("word_chars") / words
    return {
        "base": base_failed(),
        "symbols": F.col("n_symbols") > SOFT_SYMBOLS * words,
        "lines": F.col("n_dup_lines") > SOFT_DUP_LINES * F.greatest(F.col("n_lines"), F.lit(1)),
        "length": (mean < SOFT_WORD_LENGTH[0]) | (mean > SOFT_WORD_LENGTH[1]),
    }


def host_rates(measured: DataFrame, host_col: str = "source") -> DataFrame:
    """``(host, rule, n, failed, rate, shrunk, excess)``: one row for each host and rule.

    excess is by how many posterior standard deviations shrunk, the posterior
    mean, lies above the rule's rate over all documents.

    The prior of a rule is the beta distribution whose mean and variance are
    those of the hosts' rates, less the variance that sampling explains
    (moments). It comes from one grouped row for each of the few rules, joined
    on the rule.
    """
    fails = soft_failures()
    by_host = measured.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("n"), *(F.sum(fails[r].cast("long")).alias(r) for r in RULES))
    stacked = by_host.select("host", "n", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("failed")) for r in RULES))).alias("x")).select("host", "n", "x.rule", "x.failed")
    prior = stacked.groupBy("rule").agg(
        (F.sum("failed") / F.sum("n")).alias("mean"),
        F.coalesce(F.var_samp(F.col("failed") / F.col("n")), F.lit(0.0)).alias("seen"),
        F.avg(1.0 / F.col("n")).alias("thin"),
    )
    spread = F.col("mean") * (1 - F.col("mean"))
    real = F.col("seen") - spread * F.col("thin")
    weight = F.when(real > spread / (MAX_PRIOR + 1), F.greatest(spread / real - 1, F.lit(MIN_PRIOR))).otherwise(MAX_PRIOR)
    prior = prior.select(F.col("rule").alias("rule_"), "mean", weight.alias("weight"))
    shrunk = (F.col("failed") + F.col("mean") * F.col("weight")) / (F.col("n") + F.col("weight"))
    deviation = F.sqrt(F.col("shrunk") * (1 - F.col("shrunk")) / (F.col("n") + F.col("weight") + 1))
    joined = stacked.join(F.broadcast(prior), F.col("rule") == F.col("rule_")).withColumn("shrunk", shrunk)
    excess = F.when(F.col("shrunk") <= F.col("mean"), 0.0).when(deviation > 0, (F.col("shrunk") - F.col("mean")) / deviation).otherwise(float("inf"))
    return joined.select("host", "rule", "n", "failed", (F.col("failed") / F.col("n")).alias("rate"), "shrunk", excess.alias("excess"))


MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def verdicts(docs: DataFrame, text_col: str, host_col: str, columns: list[str]) -> DataFrame:
    """``(row, n_words, ..., base_failed, host_rate, kept)``; row is the struct of ``columns``."""
    packed = docs.select(struct_of(columns).alias("row"), named(text_col).alias("text"), named(host_col).alias("host"))
    # Measured once, and written: filters on the measures must not be pushed into their computation.
    measured = materialize(measure(packed, "text").drop("text"), "measures")
    bad = host_rates(measured, "host").filter(F.col("excess") > CERTAINTY)
    bad = materialize(bad.groupBy(F.col("host").alias("host_")).agg(F.max("shrunk").alias("host_rate"), F.collect_set("rule").alias("rules")), "hosts")
    if bad.count() <= BROADCAST_HOSTS:
        bad = F.broadcast(bad)
    fails = soft_failures()
    found = F.array_compact(F.array(*(F.when(fails[r], F.lit(r)) for r in RULES)))
    joined = measured.join(bad, F.col("host").eqNullSafe(F.col("host_")), "left")
    condemned = F.coalesce(F.arrays_overlap(found, F.col("rules")), F.lit(False))
    return joined.select("row", *MEASURES, base_failed().alias("base_failed"), F.coalesce("host_rate", F.lit(0.0)).alias("host_rate"), (~base_failed() & ~condemned).alias("kept"))


def judge_documents(docs: DataFrame, text_col: str = "text", host_col: str = "source", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` with measures, base_failed, host_rate and kept.

    kept is false for base failures and for documents that fail a soft rule
    whose host is condemned for it; a document that fails nothing is always
    kept, whatever its host. A null host is a host of its own. Measures and
    verdicts replace columns of the same names; rows keep their multiplicity,
    and an empty table gives an empty result.
    """
    made = [*MEASURES, "base_failed", "host_rate", "kept"]
    keep = [c for c in (docs.columns if columns is None else columns) if c.lower() not in made]
    return verdicts(docs, text_col, host_col, keep).select(*fields_of("row", keep), *made)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all documents.

    Null and empty texts have no words and fail; repeated rows keep their rows;
    an empty table gives no rows.
    """
    out = judge_documents(table(spark, sf_dir, "documents"), columns=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stage_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with all their columns as they are, whatever their names.

    Null and empty texts go; repeated rows stay repeated; an empty table stays empty.
    """
    return verdicts(docs, "text", "source", docs.columns).filter("kept").select(*fields_of("row", docs.columns))
