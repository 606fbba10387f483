"""Personal data and the terms that would give it away, in DataFrame operations.

Patterns find direct identifiers (email, ip, card, phone). Terms are then judged
by how much they disclose: over the whole corpus, the pointwise mutual
information of a term and an identifier with which it shares a text, as a share
of the identifier's information content (after Sanchez and Batet). A term that
discloses nearly everything is removed from all texts that hold the identifier,
one above a lower threshold is generalised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.session import materialize

from .common import fields_of, named, struct_of, table
from .spans import apart, count_of, cut, ends_of, find_spans, let, merge_kinds, no_spans, only, pieces_of, running, spelled

#: Possessive and anchored forms of the contract's patterns: same matches, no deep recursion, no rescans of long runs.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[ -]?+[0-9]){11,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
REVEAL, HINT = "reveal", "hint"
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", REVEAL: ""}
#: Share of the identifier's information above which a term is removed, or generalised.
REMOVE, GENERALISE = 0.9, 0.6
#: Rows of two or three numbers each that may be broadcast; beyond, they are joined by shuffling.
BROADCAST_ROWS = 1_000_000


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether 12 to 19 digits pass the Luhn test."""
    back = F.reverse(number)
    total = F.lit(0)
    for k in range(19):
        d = F.coalesce(F.try_to_number(F.substring(back, k + 1, 1), F.lit("9")).cast("int"), F.lit(0))
        total = total + (d if k % 2 == 0 else 2 * d - F.when(d > 4, 9).otherwise(0))
    return F.length(number).between(12, 19) & (total % 10 == 0)


def small_parts(address: Column) -> Column:
    """Whether all dotted parts are at most 255, however many leading zeros they have."""
    return F.forall(F.split(address, r"\."), lambda x: F.coalesce(F.regexp_replace(x, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"), F.lit(False)))


def identifiers(text: Column) -> Column:
    """All base spans of a text that isn't null."""
    found = {
        "email": find_spans(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": only(find_spans(text, IP, F.rlike(text, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"))), small_parts),
        "card": only(find_spans(text, CARD, F.rlike(text, F.lit(CARD))), lambda m: luhn(digits(m))),
        "phone": only(find_spans(text, PHONE, F.contains(text, F.lit("+"))), lambda m: F.length(digits(m)).between(9, 15)),
    }
    return merge_kinds([(k, found[k]) for k in KINDS])


def term_key(term: Column) -> Column:
    return F.xxhash64(F.lower(term))


def terms_of(text: Column) -> Column:
    """Hashes of a text's different terms: its runs of letters, lower-cased."""
    return F.array_distinct(F.transform(F.filter(F.split(text, r"[^\p{L}]+"), lambda x: F.length(x) > 0), term_key))


def entity(span: Column) -> Column:
    """An identifier's normal form: kind, and lower-case text or digits."""
    plain = F.when(span["kind"].isin("card", "phone"), digits(span["match"])).otherwise(F.lower(span["match"]))
    return F.concat_ws(":", span["kind"], plain)


#: Terms that are looked up one by one; more are merged with the text's words by hash.
FEW_TERMS = 16


def term_spans(text: Column, terms: Column) -> Column:
    """Occurrences of the terms (hashes) as whole runs of letters, as (start, end, match)."""

    def merged(words: Column) -> Column:
        asked = F.transform(terms, lambda h: F.struct(h.alias("h"), F.lit(0).alias("own"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("match")))
        held = F.transform(words, lambda x: F.struct(term_key(x["match"]).alias("h"), F.lit(1).alias("own"), x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match")))

        def wanted(marks: Column) -> Column:
            last = ends_of(running(F.transform(marks, lambda m: F.when(m["own"] == 0, m["h"])), F.greatest, F.lit(None).cast("long")))
            judged = F.zip_with(marks, last, lambda m, h: F.struct(m.alias("m"), ((m["own"] == 1) & h.eqNullSafe(m["h"])).alias("ok")))
            return F.sort_array(F.transform(F.filter(judged, lambda x: x["ok"]), lambda x: F.struct(x["m"]["start"].alias("start"), x["m"]["end"].alias("end"), x["m"]["match"].alias("match"))))

        few = F.filter(words, lambda x: F.array_contains(terms, term_key(x["match"])))
        return F.when(F.size(terms) <= FEW_TERMS, few).otherwise(let(F.sort_array(F.concat(asked, held)), wanted))

    some = F.coalesce(F.size(terms) > 0, F.lit(False))
    return F.when(some, let(find_spans(text, r"\p{L}++", F.lit(True)), merged)).otherwise(no_spans())


def small(df: DataFrame) -> DataFrame:
    """``df`` with a hint to broadcast it where it has at most BROADCAST_ROWS rows of numbers."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def one_of_each(rows: DataFrame, copied: DataFrame) -> DataFrame:
    """One row for each ``key``; ``copied`` lists the keys of several rows, and only such rows are shuffled."""
    again = rows.join(copied, "key", "left_semi").groupBy("key").agg(*(F.first(c).alias(c) for c in rows.columns if c != "key"))
    return rows.join(copied, "key", "left_anti").unionByName(again)


def frequent(counts: DataFrame, n: str) -> tuple[DataFrame, int]:
    """The most frequent rows, at most BROADCAST_ROWS, and the largest count that any other can have."""
    level = F.floor(F.log2(n))
    sizes = sorted(((r["level"], r["k"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect()), reverse=True)  # at most 64 levels
    least, room = 62, BROADCAST_ROWS
    for at, k in sizes:
        room -= k
        if room < 0:
            break
        least = at
    floor = 1 if sizes and least == sizes[-1][0] else 1 << int(least)
    return counts.filter(F.col(n) >= floor), floor - 1


def disclosing_terms(docs: DataFrame, private: DataFrame, text_col: str) -> DataFrame:
    """``(key, term, share)``: terms of a text that disclose at least GENERALISE of an identifier in it.

    ``private`` has (key, entities, t) of the rows with identifiers, key being a
    hash of the text. All counts are of different texts, so that copies add
    nothing. A term of n texts can reach the threshold for an identifier of m,
    among N, only if n is at most N^(1 - GENERALISE) m^GENERALISE; pairs beyond
    that are dropped before anything is shuffled, by the counts of the most
    frequent terms and identifiers. An identifier of one text shares that text
    with each of its terms, so that only the others' pairs are counted.
    """
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("key"), F.col(text_col).alias("t"))
    texts = materialize(rows.groupBy("key").agg(F.count("*").alias("rows")), "texts")
    total = float(max(texts.count(), 1))
    copied = small(texts.filter("rows > 1").select("key"))
    own = one_of_each(rows, copied).select(F.explode(terms_of(F.col("t"))).alias("term"))
    counts = materialize(own.groupBy("term").agg(F.count("*").alias("n_term")), "terms")
    held = one_of_each(private, copied)
    entities = materialize(held.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity")), "entities")
    common, _ = frequent(counts, "n_term")

    def reachable(n_entity: Column, n_term: Column) -> Column:
        return F.log2(F.lit(total) / F.greatest(n_entity, n_term)) >= GENERALISE * F.log2(F.lit(total) / n_entity) - 1e-9

    by_key = held.select("key", F.explode("entities").alias("entity")).join(entities, "entity").groupBy("key").agg(
        F.bool_or(F.col("n_entity") == 1).alias("alone"), F.collect_list(F.when((F.col("n_entity") > 1) & (F.col("n_entity") < total), F.struct("entity", "n_entity"))).alias("shared")
    )
    by_key = materialize(by_key.filter(F.col("alone") & (F.lit(total) > 1) | (F.size("shared") > 0)), "by_key")
    terms = held.select("key", "t").join(small(by_key.select("key")), "key", "left_semi").select("key", F.explode(terms_of(F.col("t"))).alias("term"))
    most = small(by_key.select("key", F.coalesce(F.array_max(F.transform("shared", lambda x: x["n_entity"])), F.lit(1)).alias("most")))
    terms = terms.join(F.broadcast(common), "term", "left").join(most, "key").filter(reachable(F.col("most"), F.coalesce("n_term", F.lit(1))))
    terms = materialize(terms.select("key", "term", "n_term"), "pairs")
    # Frequent terms have their counts by now; the others get theirs by a join.
    rest = terms.filter("n_term IS NULL").drop("n_term").join(counts, "term")
    exact = materialize(terms.filter("n_term IS NOT NULL").unionByName(rest), "exact")

    def share(n_entity: Column, n_both: Column) -> Column:
        return F.try_divide(F.log2(F.lit(total) * n_both / (n_entity.cast("double") * F.col("n_term"))), F.log2(F.lit(total) / n_entity))

    # For an identifier of one text a term's count alone decides, so that the text's terms are judged once for all of them.
    single = exact.join(small(by_key.filter("alone").select("key")), "key", "left_semi").select("key", "term", share(F.lit(1), F.lit(1)).alias("share"))
    several = by_key.filter(F.size("shared") > 0).select("key", F.explode("shared").alias("x")).select("key", "x.*")
    exact = exact.join(several, "key").filter(reachable(F.col("n_entity"), F.col("n_term")))
    both = exact.groupBy("entity", "term", "n_entity", "n_term").agg(F.count("*").alias("n_both"))
    told = both.select("entity", "term", share(F.col("n_entity"), F.col("n_both")).alias("share")).filter(F.col("share") >= GENERALISE)
    shared = exact.join(told, ["entity", "term"]).select("key", "term", "share")
    return single.filter(F.col("share") >= GENERALISE).unionByName(shared).groupBy("key", "term").agg(F.max("share").alias("share"))


def class_of(term: Column) -> Column:
    """What a term is generalised to, by its form: [ACRONYM], [NAME] or [WORD]."""
    return F.when(term.rlike(r"^\p{Lu}{2,}$"), "[ACRONYM]").when(term.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")


def masked(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the label of its first."""
    label = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))

    def joined(pieces: Column) -> Column:
        def parts(reached: Column) -> Column:
            """What stands from the end of all spans before to the span, and its label; nothing for a span inside those before."""
            own = F.zip_with(spans, F.slice(reached, 1, F.size(spans)), lambda x, at: F.when(x["start"] < at, "").otherwise(F.concat(cut(pieces, at, x["start"]), F.when(x["kind"] == HINT, class_of(x["match"])).otherwise(F.element_at(label, x["kind"])))))
            return F.array_join(F.concat(own, F.array(cut(pieces, F.element_at(reached, -1), F.length(text)))), "")

        return let(running(F.transform(spans, lambda x: x["end"]), F.greatest, F.lit(0)), parts)

    return F.when(F.size(spans) > 0, let(pieces_of(text), joined)).otherwise(text)


def sanitise(docs: DataFrame, text_col: str = "text", columns: list[str] | None = None, mask: bool = True) -> DataFrame:
    """``columns`` of every row with spans and, with ``mask``, sanitised.

    spans are the identifiers' and, of kinds reveal and hint, all occurrences of
    disclosing terms in every text that holds the identifier they disclose; the
    latter never overlap identifiers. sanitised is the text with identifiers
    replaced by their kind, revealing terms removed and hinting ones generalised
    to a class. A null or empty text has no spans and stays as it is; rows keep
    their multiplicity; an empty table gives an empty result. Input columns
    named spans or sanitised are replaced.
    """
    keep = [c for c in (columns or docs.columns) if c.lower() not in ("spans", "sanitised")]
    carried = mask or text_col in keep
    keep_text = keep if text_col in keep or not mask else [*keep, text_col]
    text = F.col("t")
    rows = docs.select(struct_of(keep_text).alias("row"), named(text_col).alias("t"))
    rows = rows.withColumn("spans", F.when(text.isNull(), merge_kinds([("email", no_spans())])).otherwise(identifiers(F.coalesce(text, F.lit("")))))
    # Only texts with identifiers are needed further, unless they are among the columns anyway.
    found = materialize(rows.select("row", "spans") if carried else rows.select("row", "spans", F.when(F.size("spans") > 0, text).alias("t")), "identifiers")
    found = found.withColumn("t", F.col("row")[f"c{keep_text.index(text_col)}"]) if carried else found
    own = F.array_distinct(F.transform("spans", lambda x: F.xxhash64(entity(x))))
    holders = found.filter(F.size("spans") > 0).withColumn("key", F.xxhash64("t"))
    plain = docs.select(named(text_col).alias("text"))
    by_text = disclosing_terms(plain, holders.select("key", own.alias("entities"), "t"), "text")
    strong = F.col("share") >= REMOVE
    by_text = by_text.groupBy(F.col("key").alias("key_")).agg(
        F.array_sort(F.collect_list(F.when(strong, F.col("term")))).alias("reveal"),
        F.array_sort(F.collect_list(F.when(~strong, F.col("term")))).alias("hint"),
    )
    joined = holders.join(by_text, F.col("key") == F.col("key_"), "left")

    def occurrences(terms: str) -> Column:
        return apart(term_spans(F.col("t"), F.col(terms)), F.col("spans"))

    base = [only_kind(F.col("spans"), k) for k in KINDS]
    everything = merge_kinds([*zip(KINDS, base, strict=True), (REVEAL, occurrences("reveal")), (HINT, occurrences("hint"))])
    out = joined.select("row", "t", F.when(F.col("key_").isNull(), F.col("spans")).otherwise(everything).alias("spans"))
    out = out.unionByName(found.filter(F.size("spans") == 0).select("row", "t", "spans"))
    names = fields_of("row", keep)
    if not mask:
        return out.select(*names, "spans")
    return out.select(*names, "spans", F.when(F.size("spans") > 0, masked(F.col("t"), F.col("spans"))).otherwise(F.col("t")).alias("sanitised"))


def only_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: x["kind"] == kind)


def op4_privacy(spark, sf_dir: str) -> DataFrame:
    """Spans of all documents: identifiers, and the terms that disclose them.

    Null and empty texts have none; repeated rows keep their rows; an empty
    table gives no rows.
    """
    found = sanitise(table(spark, sf_dir, "documents"), columns=["doc_id"], mask=False)
    own = F.filter("spans", lambda x: x["kind"].isin(*KINDS))
    counts = [count_of(F.col("spans"), k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(spelled(own), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))


def stage_privacy(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their texts sanitised, and n_chars to match where that is a column.

    Null and empty texts stay as they are, repeated rows stay repeated and are
    all sanitised alike, an empty table stays empty.
    """
    others = [c for c in docs.columns if c != "text"]
    out = sanitise(docs.select(struct_of(others).alias("doc"), "text"), columns=["doc", "text"])
    changed = F.size("spans") > 0

    def column(name: str) -> Column:
        if name == "text":
            return F.col("sanitised").alias("text")
        own = F.col("doc")[f"c{others.index(name)}"]
        if name.lower() == "n_chars":
            return F.when(changed, F.length("sanitised").cast(docs.schema[name].dataType)).otherwise(own).alias(name)
        return own.alias(name)

    return out.select(*map(column, docs.columns))
