"""Durations, bitrates and sizes from free text, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fuzzy import bind

#: Spellings in the order in which they are replaced.
HOURS = ("часа", "часов", "час.", "час", "ч.", "ч", "hours", "hour", "h")
MINUTES = ("минута", "минуты", "минут", "мин.", "мин", "м.", "м", "minutes", "min.", "min", "m")
SECONDS = ("секунда", "секунды", "секунд", "сек.", "сек", "с.", "с", "seconds", "sec.", "sec")
JUNK = ("примерно", "около", "~", "&#8776;")
KBPS = (
    "kbps", "kbts", "kbit / sec", "kbit / s", "kbs", "kbp / s", "kb / s", "кb / s", "кbps", "kbit",
    "кбит / сек", "кбит / с", "кб / с", "к / с", "кбит", "кбс", "kpbs",
)
#: Words that say nothing about a bitrate.
BITRATE_JUNK = ("~", "vbr", "cbr")
#: Size units and their bytes.
UNITS = {"Гб": 1 << 30, "GB": 1 << 30, "Мб": 1 << 20, "MB": 1 << 20, "Кб": 1 << 10, "KB": 1 << 10}


def replace_each(x: Column, olds: tuple[str, ...], new: str) -> Column:
    for old in olds:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def mentions(x: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(x, w))


def number(x: Column) -> Column:
    """A 16-bit number; anything else is 0."""
    found = F.trim(x).try_cast("smallint")
    return F.coalesce(F.when(F.trim(x).rlike("^[+-]?[0-9]+$"), found), F.lit(0)).cast("int")


def insert(parts: Column, place: int, *new: Column) -> Column:
    """``parts`` with new ones before the given place."""
    return F.concat(F.slice(parts, 1, place), F.array(*new), F.slice(parts, F.lit(place + 1), F.greatest(F.size(parts) - place, F.lit(0))))


def worded_parts(low: Column) -> Column:
    """Hours, minutes and seconds of a value with unit words; null where it has none."""
    zero = F.lit("00")
    h, m, s = mentions(low, HOURS), mentions(low, MINUTES), mentions(low, SECONDS)
    marked = F.split(replace_each(replace_each(replace_each(low, HOURS, ":"), MINUTES, ":"), SECONDS, ":"), ":", -1)

    def padded(x: Column) -> Column:
        h, m, s, p = x["h"], x["m"], x["s"], x["p"]
        return (
            F.when(~(h | m | s), F.lit(None))
            .when((F.size(p) >= 2) & h & m & ~s, insert(p, 2, zero))
            .when(~h & m & ~s, insert(insert(p, 0, zero), 2, zero))
            .when(h & ~m & ~s, insert(p, 1, zero, zero))
            .when(~h & m & s, insert(p, 0, zero))
            .otherwise(p)
        )

    return bind(F.struct(h.alias("h"), m.alias("m"), s.alias("s"), marked.alias("p")), padded)


def single_duration(x: Column) -> Column:
    """Seconds of one value such as ``05:30:15``, ``10. 20`` or ``5 h 20 min``."""
    zero = F.lit("00")

    def parts_of(x: Column) -> Column:
        dotted = F.split(x, r"\. ")
        is_dotted = F.size(dotted).between(2, 3) & F.forall(dotted, lambda p: F.trim(p).rlike("^[0-9]{1,3}$") & (p.try_cast("int") <= 255))
        clock = (F.length(x) >= 7) & x.rlike(r"^[0-9]+(:[0-9]+){1,3}$")
        low = replace_each(F.lower(x), (" ", ",", "."), "")
        plain = F.when(F.length(x) <= 2, F.array(zero, zero, x)).otherwise(F.split(low, ":", -1))
        return F.when(clock, F.split(x, ":", -1)).when(is_dotted, dotted).otherwise(F.coalesce(bind(low, worded_parts), plain))

    def seconds(p: Column) -> Column:
        return F.when(F.size(p) >= 3, 3600 * number(F.get(p, F.lit(0))) + 60 * number(F.get(p, F.lit(1))) + number(F.get(p, F.lit(2)))).otherwise(0)

    parts = bind(F.trim(replace_each(x, JUNK, "")), parts_of)
    return bind(bind(parts, lambda p: F.when(F.size(p) == 2, F.concat(F.array(zero), p)).otherwise(p)), seconds)


def duration_seconds(x: Column) -> Column:
    """Seconds of values joined by ``+`` or `` и ``; null and empty give 0."""
    values = F.split(F.coalesce(x, F.lit("")), r"\+| и ")
    return F.aggregate(F.transform(values, single_duration), F.lit(0), lambda a, b: a + b)


def bitrate_kbps(x: Column) -> Column:
    """Kilobits per second; what can't be read is 0."""
    low = replace_each(F.lower(F.coalesce(x, F.lit(""))), KBPS, "kbps")
    parts = F.split(low, ",| и |/")
    main = F.when(F.size(parts) > 1, F.get(F.filter(parts, lambda p: mentions(p, KBPS)), F.lit(0))).otherwise(low)
    main = F.trim(F.substring_index(F.trim(replace_each(main, BITRATE_JUNK, " ")), "kbps", 1))
    ends = F.transform(F.split(F.substring_index(main, " ", -1), "-"), lambda v: F.when(v.rlike("^[0-9]{1,9}$"), v.try_cast("int")))
    two = F.floor((F.get(ends, F.lit(0)) + F.get(ends, F.lit(1))) / 2).cast("int")
    return F.coalesce(F.when(F.size(ends) == 1, F.get(ends, F.lit(0))).when(F.size(ends) == 2, two), F.lit(0))


def size_bytes(x: Column) -> Column:
    """Bytes of ``number unit``: an unsigned decimal with a dot or comma, one blank, a unit in its own case; anything else gives 0."""
    words = F.split(F.coalesce(x, F.lit("")), " ")
    factor = F.lit(0)
    for unit, size in UNITS.items():
        factor = F.when(F.get(words, F.lit(1)) == unit, F.lit(float(size))).otherwise(factor)
    plain = F.translate(F.get(words, F.lit(0)), ",", ".")
    value = F.when(plain.rlike(r"^(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"), plain.try_cast("float"))
    return F.coalesce((value * factor.cast("float")).cast("long"), F.lit(0))


def effective_seconds(size: Column, kbps: Column, stated: Column) -> Column:
    """Length from size and bitrate; the stated one where both nearly agree or no bitrate is known."""
    computed = F.floor(size / (kbps * 128))
    close = (stated > 0) & (stated / computed > 0.8) & (stated / computed < 1.2)
    return F.when(size <= 0, 0).when(kbps <= 0, stated).when(close, stated).otherwise(computed).cast("long")
