"""Text normalisation, multi-value splitting and name parsing as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fuzzy import bind, tokens

#: Latin letters and the Cyrillic ones they look like.
HOMOGLYPH_FROM = "AaKkCcTtOoPpHhXxMmEeBGgz"
HOMOGLYPH_TO = "АаКкСсТтОоРрНнХхМмЕеВГгз"
#: Letters that are left alone in genres.
GENRE_KEPT = "GgZz"
#: What separates an author from a title, in the order in which it is sought.
TITLE_SEPARATORS = (" - ", " – ", " — ", " -- ")


def normalize(x: Column) -> Column:
    """Lower case, yo as ye, runs of anything but letters and digits as one blank; null gives an empty string."""
    plain = F.translate(F.lower(F.coalesce(x, F.lit(""))), "ё", "е")
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{Nd}]+", " "))


def trim_to_length(x: Column, n: int) -> Column:
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n - 1), F.lit("…"))).otherwise(x)


def split_values(x: Column, pattern: str, strip: str = "") -> Column:
    """Trimmed, non-empty parts; a null gives none."""
    parts = F.transform(F.split(F.coalesce(x, F.lit("")), pattern), lambda v: F.trim(F.translate(v, strip, "") if strip else v))
    return F.filter(parts, lambda v: v != "")


def genres(x: Column) -> Column:
    return split_values(x, r"[,/.>|;]", '"=')


def genre_atoms(x: Column) -> Column:
    """The split that label mapping uses."""
    return split_values(x, r"[,;/|]")


def people(x: Column) -> Column:
    """Author or reader values: at most two blank-separated segments stay whole."""
    return F.when(x.isNull() | (F.trim(x) == ""), F.expr("cast(array() as array<string>)")).when(F.size(F.split(x, " ")) <= 2, F.array(x)).otherwise(split_values(x, r"[,/>|]"))


def free_readings(raw: Column) -> Column:
    """Both orders of a name in free form, as (surname, given)."""
    words = tokens(normalize(raw))
    n = F.size(words)

    def reading(surname: Column, given: Column) -> Column:
        return F.struct(surname.alias("surname"), F.array_join(given, " ").alias("given"))

    last_first = reading(F.element_at(words, -1), F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))))
    first_first = reading(F.element_at(words, 1), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))))
    none = F.filter(F.array(reading(F.lit(""), F.array(F.lit("")))), lambda _: F.lit(False))
    return F.when(n == 0, none).when(n == 1, F.array(reading(F.get(words, F.lit(0)), F.array(F.lit(""))))).otherwise(F.array(last_first, first_first))


def author_slots(raw: Column) -> Column:
    """People named in a string, each with its readings (surname, given).

    ``;``, ``/`` and ``&`` separate people. Within a part whose first comma has
    no blank before it the comma separates surname and given name; otherwise
    commas separate people.
    """
    def slots(part: Column) -> Column:
        first = F.substring_index(part, ",", 1)
        head = F.trim(first)
        comma = F.contains(part, F.lit(",")) & (F.length(first) > 0)
        given = normalize(F.substring(part, F.length(first) + 2, F.length(part)))
        one = F.array(F.array(F.struct(normalize(head).alias("surname"), given.alias("given"))))
        several = F.transform(F.split(part, ","), free_readings)
        return F.when(comma & ~F.contains(head, F.lit(" ")), one).when(comma, several).otherwise(F.array(free_readings(part)))

    parts = split_values(raw, r"[;/&]")
    return F.filter(F.flatten(F.transform(parts, slots)), lambda x: F.size(x) > 0)


def looks_like_author(left: Column, author: Column) -> Column:
    """A blank author fits anything; else one of its tokens of two or more letters must be there."""
    long_tokens = F.filter(tokens(normalize(author)), lambda t: F.length(t) > 1)
    return (normalize(author) == "") | F.arrays_overlap(long_tokens, tokens(normalize(left)))


#: What is cut from a title's end before a bracket is sought.
TITLE_TAIL = " .,"
CLOSING = {")": "(", "]": "[", "}": "{"}


def strip_brackets(x: Column) -> Column:
    """Trailing bracket groups removed, however many and however deeply nested; a title that is one group stays.

    Read from the end, each character changes the depth of the group that it
    stands in; a group ends with the opener at depth zero. A closer whose opener
    isn't found, or stands at the title's start, ends the search.
    """
    return bind(x, without_groups)


def without_groups(x: Column) -> Column:
    start = F.struct(F.lit(None).cast("string").alias("open"), F.lit(None).cast("string").alias("shut"), F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("cut"), F.lit(False).alias("done"))

    def state(open_: Column, shut: Column, depth: Column, seen: Column, cut: Column, done: Column) -> Column:
        return F.struct(open_.alias("open"), shut.alias("shut"), depth.alias("depth"), seen.alias("seen"), cut.alias("cut"), done.alias("done"))

    none = F.lit(None).cast("string")

    def step(acc: Column, c: Column) -> Column:
        seen = acc["seen"] + 1
        outside = F.when(c.isin(*TITLE_TAIL), state(none, none, F.lit(0), seen, seen, F.lit(False)))
        for shut, open_ in CLOSING.items():
            outside = outside.when(c == shut, state(F.lit(open_), F.lit(shut), F.lit(1), seen, acc["cut"], F.lit(False)))
        outside = outside.otherwise(state(none, none, F.lit(0), seen, acc["cut"], F.lit(True)))
        depth = acc["depth"] + F.when(c == acc["shut"], 1).when(c == acc["open"], -1).otherwise(0)
        first = seen == F.length(x)
        inside = F.when(depth > 0, state(acc["open"], acc["shut"], depth, seen, acc["cut"], F.lit(False))).when(first, state(none, none, F.lit(0), seen, acc["cut"], F.lit(True))).otherwise(state(none, none, F.lit(0), seen, seen, F.lit(False)))
        return F.when(acc["done"], acc).when(acc["depth"] > 0, inside).otherwise(outside)

    letters = F.split(F.reverse(x), "")
    cut = F.aggregate(F.filter(letters, lambda c: c != ""), start, step, lambda acc: acc["cut"])
    return F.when(x.isNotNull(), F.substring(x, F.lit(1), F.length(x) - cut))


def clean_title(title: Column, author: Column) -> Column:
    """The title without a leading author, trailing brackets, quotes and dashes."""
    long_tokens = F.filter(tokens(normalize(author)), lambda t: F.length(t) > 1)

    def without_author(raw: Column, known: Column) -> Column:
        choices = []
        for separator in TITLE_SEPARATORS:
            at = F.instr(raw, separator)
            left, right = F.substring(raw, F.lit(1), at - 1), F.substring(raw, at + len(separator), F.length(raw))
            fits = (normalize(author) == "") | F.arrays_overlap(known, tokens(normalize(left)))
            choices.append(F.when((at > 1) & (F.trim(right) != "") & fits, right))
        return F.coalesce(*choices, raw)

    right = bind(F.struct(F.trim(F.coalesce(title, F.lit(""))).alias("raw"), long_tokens.alias("known")), lambda x: without_author(x["raw"], x["known"]))
    return F.regexp_replace(strip_brackets(right), "^[\\s\"'«»…–—-]+|[\\s\"'«»…–—-]+$", "")


def repair_homoglyphs(x: Column, kept: str = "") -> Column:
    """Look-alike Latin letters, but for the ``kept`` ones, within runs of Latin letters that Cyrillic ones follow."""
    pairs = [(a, b) for a, b in zip(HOMOGLYPH_FROM, HOMOGLYPH_TO, strict=True) if a not in kept]
    pattern = F.lit("[A-Za-z]+[А-Яа-я]+")
    between, found = F.split(x, pattern, -1), F.regexp_extract_all(x, pattern, F.lit(0))
    joined = F.zip_with(between, found, lambda gap, m: F.concat(gap, F.coalesce(F.translate(m, "".join(a for a, _ in pairs), "".join(b for _, b in pairs)), F.lit(""))))
    return F.array_join(joined, "")


def compose_author(author: Column, surname: Column, given: Column) -> Column:
    """``Surname, Given`` where both are known; else what is known, if there is no author."""
    both = (F.coalesce(surname, F.lit("")) != "") & (F.coalesce(given, F.lit("")) != "")
    rest = F.concat(F.coalesce(surname, F.lit("")), F.coalesce(given, F.lit("")))
    return F.when(both, F.concat_ws(", ", surname, given)).when(F.coalesce(author, F.lit("")) == "", rest).otherwise(author)


def safe_file_name(x: Column) -> Column:
    return F.regexp_replace(x, r'["<>|:*?\\/\x00-\x1f]', "_")


def inner_text(html: Column) -> Column:
    """Text of an HTML fragment: scripts, styles and comments dropped, tags removed, blanks merged."""
    plain = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"<[^>]*>", " "), r"\s+", " "))


def links(html: Column) -> Column:
    """Targets of a page's links, quoted either way."""
    return F.regexp_extract_all(html, F.lit(r"""<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))


def magnet(html: Column) -> Column:
    """The first magnet link; null without one."""
    return F.get(F.filter(links(html), lambda x: F.startswith(x, F.lit("magnet:"))), F.lit(0))


def last_segment(url: Column) -> Column:
    """What follows the last slash of a path, without query and fragment."""
    return F.substring_index(F.regexp_replace(url, "[?#].*$", ""), "/", -1)


def page_count(html: Column) -> Column:
    """The largest whole number that is a link's whole text; 1 without any."""
    return F.greatest(F.lit(1), F.coalesce(F.array_max(F.transform(F.regexp_extract_all(html, F.lit(r"<a\b[^>]*>\s*([0-9]{1,9})\s*</a>"), F.lit(1)), lambda x: x.cast("int"))), F.lit(1)))


def page_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)


def key_value(x: Column) -> Column:
    """(key, value) around the first colon that stands at neither end; null where there is none.

    The key is lower-cased, begins after its last semicolon (unless that is its
    first character) and loses leading dashes, line feeds and dots and outer
    blanks; the value stays as it is.
    """
    at = F.instr(x, ":")
    head = F.lower(F.substring(x, F.lit(1), at - 1))
    cut = F.when(F.length(head) - F.length(F.substring_index(head, ";", -1)) > 1, F.substring_index(head, ";", -1)).otherwise(head)
    key = F.trim(F.ltrim(cut, F.lit("-\n.")), F.lit(" "))
    value = F.substring(x, at + 1, F.length(x))
    return F.when((at > 1) & (at < F.length(x)) & (key != ""), F.struct(key.alias("key"), value.alias("value")))
