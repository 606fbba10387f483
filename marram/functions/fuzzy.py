"""String similarity and phonetic keys as native column expressions.

All functions take and return Columns; a null argument gives a null result
unless stated. Lengths and distances count code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vowels merged and consonants unvoiced for the phonetic key.
METAPHONE_FROM, METAPHONE_TO = "ояеэюбздвгж", "ааииупстфкш"
#: Weights of surname and given name, and of names without a given part and of whole-name agreement.
SURNAME_WEIGHT, GIVEN_WEIGHT, NO_GIVEN, WHOLE_NAME = 0.65, 0.35, 0.9, 0.98


def bind(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; two empty strings are equal."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def tokens(x: Column) -> Column:
    return F.filter(F.split(x, " "), lambda t: t != "")


def token_sort_ratio(a: Column, b: Column) -> Column:
    def ordered(x: Column) -> Column:
        return F.array_join(F.array_sort(tokens(x)), " ")

    return ratio(ordered(a), ordered(b))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Best ratio among the shared tokens and the shared tokens followed by either side's own."""
    left, right = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    both = F.array_sort(F.array_intersect(left, right))
    shared = F.array_join(both, " ")
    whole_a = F.array_join(F.concat(both, F.array_sort(F.array_except(left, right))), " ")
    whole_b = F.array_join(F.concat(both, F.array_sort(F.array_except(right, left))), " ")
    forms = F.struct(shared.alias("s"), whole_a.alias("a"), whole_b.alias("b"))
    return bind(forms, lambda x: F.greatest(ratio(x["s"], x["a"]), ratio(x["s"], x["b"]), ratio(x["a"], x["b"])))


def jaro(a: Column, b: Column) -> Column:
    """Jaro similarity with half transpositions kept; two empty strings give 1, one gives 0.

    A fold over the first string's characters takes, for each, the first unused
    equal character of the second within the window.
    """
    left, right = (F.filter(F.split(x, ""), lambda c: c != "") for x in (a, b))
    la, lb = F.length(a), F.length(b)
    reach = F.greatest(F.floor(F.greatest(la, lb) / 2) - 1, F.lit(0))
    start = F.struct(F.lit(0).alias("i"), F.expr("cast(array() as array<int>)").alias("used"), F.expr("cast(array() as array<string>)").alias("hit"))

    def step(acc: Column, c: Column) -> Column:
        open_places = F.filter(F.sequence(F.lit(0), lb - 1), lambda j: (F.abs(j - acc["i"]) <= reach) & (F.get(right, j) == c) & ~F.array_contains(acc["used"], j))
        j = F.get(open_places, F.lit(0)).cast("int")
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(j.isNull(), acc["used"]).otherwise(F.concat(acc["used"], F.array(j))).alias("used"),
            F.when(j.isNull(), acc["hit"]).otherwise(F.concat(acc["hit"], F.array(c))).alias("hit"),
        )

    def score(acc: Column) -> Column:
        other = F.transform(F.array_sort(acc["used"]), lambda j: F.get(right, j))
        m = F.size(acc["hit"]).cast("double")
        moved = F.aggregate(F.zip_with(acc["hit"], other, lambda x, y: F.when(x != y, 0.5).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
        return F.when(m == 0, 0.0).otherwise((m / la + m / lb + (m - moved) / m) / 3)

    empty = (la == 0) | (lb == 0)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when((la == 0) & (lb == 0), 1.0).when(empty, 0.0).otherwise(F.aggregate(left, start, step, score))


def jaro_winkler(a: Column, b: Column, weight: float = 0.1) -> Column:
    """Jaro raised by a common prefix of up to four characters, at any similarity."""
    prefix = F.lit(0)
    for k in range(4, 0, -1):
        same = (F.length(a) >= k) & (F.length(b) >= k) & (F.substring(a, 1, k) == F.substring(b, 1, k))
        prefix = F.when(same, F.greatest(prefix, F.lit(k))).otherwise(prefix)
    return bind(jaro(a, b), lambda base: base + prefix * weight * (1 - base))


def metaphone(surname: Column) -> Column:
    """Phonetic key of a normalised Cyrillic surname."""
    plain = F.translate(surname, METAPHONE_FROM + "ьъ ", METAPHONE_TO)
    return F.regexp_replace(plain, r"(.)\1+", "$1")


def prefix_key(surname: Column) -> Column:
    return F.substring(surname, 1, 3)


def given_score(a: Column, b: Column) -> Column:
    """Initials agree with 0.9 or not at all; longer names by Jaro-Winkler."""
    short = F.least(F.length(a), F.length(b)) <= 2
    return F.when(short, F.when(F.substring(a, 1, 1) == F.substring(b, 1, 1), 0.9).otherwise(0.0)).otherwise(jaro_winkler(a, b))


def author_score(surname: Column, given: Column, other_surname: Column, other_given: Column) -> Column:
    """How well two split names agree, at most 1."""
    family = jaro_winkler(surname, other_surname)
    parts = F.when((given == "") | (other_given == ""), NO_GIVEN * family).otherwise(SURNAME_WEIGHT * family + GIVEN_WEIGHT * given_score(given, other_given))
    whole = token_set_ratio(F.concat_ws(" ", surname, given), F.concat_ws(" ", other_surname, other_given))
    return F.greatest(parts, WHOLE_NAME * whole)


def rounded(x: Column) -> Column:
    """Half-even rounding to four digits."""
    return F.bround(x, 4)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where either has no length."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, p: s + p)

    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)
