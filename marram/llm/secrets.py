"""Secret scanning through a trigram index, in DataFrame operations.

Each rule's regular expression is analysed on the driver: which trigrams must a
lower-cased text contain if it matches? The answer is a disjunction of trigram
sets. An index lists, for the trigrams that rules ask for, the texts that
contain them; intersecting the lists gives each rule's candidate texts, which
alone are searched with the expression. Rules from which no trigram follows are
searched in every text.
"""

from __future__ import annotations

import re._parser as parser
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.session import materialize

from .common import table
from .spans import count_of, find_spans, merge_kinds, only, spelled

#: Strings that an expression's part may spell before the analysis gives up on it.
MAX_STRINGS = 64
#: Candidates (16 bytes each) that may be broadcast; beyond, they are joined by shuffling.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Which matches count; the argument is the matched text.
    accept: Callable[[Column], Column] | None = None
    base: bool = False
    #: What the match begins with; whatever the expression takes before it isn't part of the match.
    head: str = ""


ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
#: What stands before the value in a match of ASSIGN.
ASSIGN_HEAD = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?"""

RULES = (
    Rule("assign", ASSIGN, lambda m: F.length(F.regexp_replace(m, ASSIGN_HEAD, "")) >= 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}+", None, True),
    Rule("hex", r"[0-9a-f]{24,}+", None, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}+"),
    # Of a run of such characters only the first eyJ can begin a match, as all of them read to the run's end; so each run is read from its start.
    Rule("jwt", r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?eyJ)[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", head="eyJ"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)

Clauses = frozenset[frozenset[str]]
#: The query that every text meets.
ANYTHING: Clauses = frozenset([frozenset()])


def reduced(clauses: Clauses) -> Clauses:
    """Without clauses that a smaller one implies."""
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def all_of(queries: list[Clauses]) -> Clauses:
    """Conjunction; where it would need too many clauses, its most selective part."""
    out = ANYTHING
    for query in sorted(queries, key=len):
        joined = reduced(frozenset(a | b for a in out for b in query))
        if len(joined) <= MAX_STRINGS:
            out = joined
    return out


def of_strings(strings: set[str]) -> Clauses:
    return reduced(frozenset(frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings))


def spellings(op, arg) -> set[str] | None:
    """All lower-cased strings that a node can match, or None where they are many."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}
    if name == "IN":
        found: set[str] = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                found.add(chr(value).lower())
            elif str(kind) == "RANGE" and value[1] - value[0] < 8:
                found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if name == "SUBPATTERN":
        return sequence_spellings(arg[3])
    if name == "BRANCH":
        parts = [sequence_spellings(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[1] == 1:
        inner = sequence_spellings(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    if name in ("AT", "ASSERT", "ASSERT_NOT"):
        return {""}
    return None


def sequence_spellings(nodes) -> set[str] | None:
    out = {""}
    for op, arg in nodes:
        own = spellings(op, arg)
        if own is None or len(out) * len(own) > MAX_STRINGS:
            return None
        out = {a + b for a, b in product(out, own)}
    return out


def sequence_query(nodes) -> Clauses:
    """What a text must contain to match the nodes one after the other."""
    queries, open_strings = [], {""}
    for op, arg in nodes:
        own = spellings(op, arg)
        if own is not None and len(open_strings) * len(own) <= MAX_STRINGS:
            open_strings = {a + b for a, b in product(open_strings, own)}
            continue
        queries.append(of_strings(open_strings))
        name = str(op)
        open_strings = {""}
        if own is not None:
            open_strings = own
        elif name == "SUBPATTERN":
            queries.append(sequence_query(arg[3]))
        elif name == "ATOMIC_GROUP":
            queries.append(sequence_query(arg))
        elif name == "BRANCH":
            queries.append(reduced(frozenset().union(*(sequence_query(x) for x in arg[1]))))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            queries.append(sequence_query(arg[2]))
    return all_of([*queries, of_strings(open_strings)])


def trigram_query(pattern: str) -> Clauses | None:
    """Trigram sets one of which is in every lower-cased text that matches; None if none is mandatory."""
    found = sequence_query(parser.parse(pattern))
    return None if frozenset() in found else found


def trigram_index(df: DataFrame, grams: list[str], text_col: str = "text") -> DataFrame:
    """``(gram, key)``: the postings of the given trigrams; key is a hash of the whole text.

    Null and empty texts have no postings, nor has an empty table. Equal texts share a key. Texts whose keys collide share their postings,
    which adds candidates and loses none.
    """
    rows = df.select(F.xxhash64(text_col).alias("key"), F.lower(text_col).alias("low"))
    held = F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(F.col("low"), g))
    return rows.select("key", F.explode(held).alias("gram")).distinct()


def candidates(postings: DataFrame, queries: dict[int, Clauses]) -> DataFrame:
    """``(key, mask)``: bit r of mask is set where the text meets rule r's query."""
    spark = postings.sparkSession
    wanted = [(g, r, c, len(clause)) for r, query in queries.items() for c, clause in enumerate(sorted(query, key=sorted)) for g in sorted(clause)]
    clauses = F.broadcast(spark.createDataFrame(wanted, "gram string, rule int, clause int, size int"))
    met = postings.join(clauses, "gram").groupBy("key", "rule", "clause", "size").agg(F.count("*").alias("n")).filter("n = size")
    return met.groupBy("key").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("mask"))


def from_head(spans: Column, head: str) -> Column:
    """The spans from the first place of ``head`` in their matches."""
    skipped = lambda x: F.instr(x["match"], head) - 1
    return F.transform(spans, lambda x: F.struct((x["start"] + skipped(x)).alias("start"), x["end"].alias("end"), F.substring(x["match"], skipped(x) + 1, F.length(x["match"])).alias("match")))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(id, spans)`` of every row; a span is (start, place, kind, end, match).

    Positions are code points, ends exclusive; spans of one rule don't overlap,
    those of different rules may. A null or empty text has no spans. Rows keep
    their multiplicity; other columns are ignored.
    """
    queries = {k: trigram_query(rule.pattern) for k, rule in enumerate(rules)}
    indexed = {k: q for k, q in queries.items() if q is not None}
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    if indexed:
        grams = sorted({g for q in indexed.values() for clause in q for g in clause})
        met = materialize(candidates(trigram_index(rows, grams, "t"), indexed), "candidates")
        if met.count() <= BROADCAST_ROWS:
            met = F.broadcast(met)
        rows = rows.withColumn("k", F.xxhash64("t")).join(met, F.col("k") == F.col("key"), "left").select("id", "t", F.coalesce("mask", F.lit(0)).alias("mask"))
    kinds = []
    for k, rule in enumerate(rules):
        when = F.col("mask").bitwiseAND(F.lit(1 << k)) != 0 if k in indexed else F.rlike("t", F.lit(rule.pattern))
        spans = find_spans(F.col("t"), rule.pattern, when)
        if rule.head:
            spans = from_head(spans, rule.head)
        if rule.accept is not None:
            spans = only(spans, rule.accept)
        kinds.append((rule.kind, spans))
    return rows.select(F.col("id").alias(id_col), merge_kinds(kinds).alias("spans"))


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents.

    Null and empty texts have none; repeated rows keep their rows; an empty
    table gives no rows.
    """
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = [r.kind for r in RULES if r.base]
    counts = [count_of(F.col("spans"), kind).alias(f"n_{kind}") for kind in base]
    own = F.filter("spans", lambda x: x["kind"].isin(base))
    return found.select("doc_id", *counts, F.sha2(spelled(own), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))
