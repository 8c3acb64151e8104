"""Text extraction columns built on the JVM regular-expression functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space of Unicode text beside space, tab, line feed and carriage return. The first row also ends lines.
LINE_BREAKS = "\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
OTHER_SPACES = "\x1f\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"

NUMBER = r"[-+]?\d+(?:\.\d*)?(?:[Ee][-+]?\d+)?"


def unix_lines(text: Column) -> Column:
    """Every line end of the file as one line feed."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def plain_spaces(text: Column) -> Column:
    """Unicode white space as characters that the patterns know: breaks become a vertical tab, the rest a space.

    Texts without such characters, nearly all, are only looked through; a text of one byte per character can hold
    the ASCII ones alone, which are looked for byte by byte.
    """
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = reduce(lambda a, b: a | b, [text.contains(c) for c in LINE_BREAKS + OTHER_SPACES if c < "\x80"])
    known = "\x0b" * len(LINE_BREAKS) + " " * len(OTHER_SPACES)
    odd = "[" + LINE_BREAKS + OTHER_SPACES + "]"
    return F.when(F.when(ascii_only, low).otherwise(text.rlike(odd)), F.translate(text, LINE_BREAKS + OTHER_SPACES, known)).otherwise(text)


def all_matches(text: Column, pattern: str, group: int = 1, ignore_case: bool = True) -> Column:
    flags = "(?i)" if ignore_case else ""
    return F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(group))


def last_match(text: Column, pattern: str, group: int = 1, ignore_case: bool = True) -> Column:
    return F.try_element_at(all_matches(text, pattern, group, ignore_case), F.lit(-1))


def first_match(text: Column, pattern: str, group: int = 1, ignore_case: bool = True) -> Column:
    flags = "(?i)" if ignore_case else ""
    return F.nullif(F.regexp_extract(text, flags + pattern, group), F.lit(""))


def last_double(text: Column, pattern: str) -> Column:
    return last_match(text, pattern).try_cast("double")


def last_int(text: Column, pattern: str) -> Column:
    return last_match(text, pattern).try_cast("int")


def max_int(text: Column, pattern: str) -> Column:
    return F.array_max(F.transform(all_matches(text, pattern), lambda m: m.try_cast("int")))


def first_of(*choices: Column) -> Column:
    return F.coalesce(*choices)


def join_parts(*parts: Column) -> Column:
    """Join with newlines, leaving out null and empty parts."""
    return F.concat_ws("\n", *[F.nullif(p, F.lit("")) for p in parts])


def single_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def bind(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``; inside a lambda a plain reference is evaluated per element."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def last_wins_map(pairs: Column, key: str, value: str) -> Column:
    """Map from an array of structs; the last value of a repeated key is kept."""
    def build(rows: Column) -> Column:
        keys = F.array_distinct(F.transform(rows, lambda p: p[key]))
        values = F.transform(keys, lambda k: F.element_at(F.filter(rows, lambda p: p[key] == k), -1)[value])
        return F.map_from_arrays(keys, values)

    return bind(pairs, build)


def canonical_json(mapping: Column) -> Column:
    """Map as JSON text with sorted keys and no spaces."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(mapping))))
