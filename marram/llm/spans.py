"""Spans of pattern matches in a text, as array columns with code-point positions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,match:string>>"
#: Elements that a running total takes together; three levels of such runs keep its time in proportion to the array.
RUN = 64
#: Characters of the pieces that a text is cut into to be read at many places.
PIECE = 1024


def no_spans() -> Column:
    return F.from_json(F.lit("[]"), SPAN)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, add: Callable[[Column, Column], Column], zero: Column, levels: int = 3) -> Column:
    """Running totals: one element more than ``values``, the first ``zero``, the next the first value, and so on.

    A fold that lengthens its array copies it at each step; here arrays are
    folded by runs of RUN elements, then the runs' totals in the same way.
    """
    if not levels:
        return F.aggregate(values, F.array(zero), lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), x))))

    def of_runs(sums: Column) -> Column:
        bases = running(F.transform(sums, lambda s: F.element_at(s, -1)), add, zero, levels - 1)
        return F.concat(F.array(zero), F.flatten(F.zip_with(sums, F.slice(bases, 1, F.size(sums)), lambda s, b: F.transform(F.slice(s, 2, RUN), lambda x: add(b, x)))))

    def runs(own: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(own), F.lit(1)), F.lit(RUN))
        return let(F.transform(starts, lambda i: running(F.slice(own, i, RUN), add, zero, 0)), of_runs)

    return let(values, runs)


def ends_of(sums: Column) -> Column:
    """Running totals without the first, which is none of the values'."""
    return F.slice(sums, 2, F.greatest(F.size(sums) - 1, F.lit(0)))


def find_spans(text: Column, pattern: str | Column, when: Column) -> Column:
    """Leftmost non-overlapping matches as (start, end, match), none unless ``when``.

    Splitting by the pattern gives what stands between the matches; the running
    total of both lengths gives the places. The pattern never matches nothing.
    """
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern

    def placed(matches: Column) -> Column:
        between = F.slice(F.transform(F.split(text, regex, -1), lambda x: F.length(x)), 1, F.size(matches))
        lengths = F.zip_with(matches, between, lambda m, gap: F.length(m) + gap)
        ends = ends_of(running(lengths, lambda a, b: a + b, F.lit(0)))
        return F.zip_with(matches, ends, lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("match")))

    return F.when(when, let(F.regexp_extract_all(text, regex, F.lit(0)), placed)).otherwise(no_spans())


def apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others, by start."""
    own = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(1).alias("own"), x["end"].alias("end"), x["match"].alias("match")))
    rest = F.transform(others, lambda x: F.struct(x["start"].alias("start"), F.lit(0).alias("own"), x["end"].alias("end"), F.lit("").alias("match")))
    none = F.lit(None).cast("int")

    def clear(marks: Column) -> Column:
        before = ends_of(running(F.transform(marks, lambda m: F.when(m["own"] == 0, m["end"])), F.greatest, none))
        after = F.reverse(ends_of(running(F.transform(F.reverse(marks), lambda m: F.when(m["own"] == 0, m["start"])), F.least, none)))
        around = F.zip_with(before, after, lambda a, b: F.struct(a.alias("before"), b.alias("after")))
        judged = F.zip_with(marks, around, lambda m, x: F.struct(m.alias("m"), ((m["own"] == 1) & (F.coalesce(x["before"], m["start"]) <= m["start"]) & (F.coalesce(x["after"], m["end"]) >= m["end"])).alias("ok")))
        return F.transform(F.filter(judged, lambda x: x["ok"]), lambda x: F.struct(x["m"]["start"].alias("start"), x["m"]["end"].alias("end"), x["m"]["match"].alias("match")))

    return let(F.sort_array(F.concat(own, rest)), clear)


def pieces_of(text: Column) -> Column:
    """The text in pieces of PIECE characters, the last shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(pieces: Column, start: Column, end: Column) -> Column:
    """Characters start to end of a text in pieces, which are found without counting from the text's beginning."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
    head = F.substring(F.get(pieces, first), start % PIECE + 1, F.least(end - start, F.lit(PIECE)))
    between = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    tail = F.coalesce(F.substring(F.get(pieces, last), F.lit(1), end % PIECE), F.lit(""))
    return F.when(start >= end, "").when(first == last, head).otherwise(F.concat(head, between, tail))


def only(spans: Column, accept: Callable[[Column], Column]) -> Column:
    """The spans whose matched text is accepted."""
    return F.filter(spans, lambda x: accept(x["match"]))


def merge_kinds(kinds: list[tuple[str, Column]]) -> Column:
    """Spans of several kinds as (start, place, kind, end, match), by start and then by place in the list."""
    def placed(spans: Column, k: int, kind: str) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("place"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["match"].alias("match")))

    parts = [placed(spans, k, kind) for k, (kind, spans) in enumerate(kinds)]
    return F.sort_array(F.concat(*parts))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    """How many spans are of the kind."""
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
