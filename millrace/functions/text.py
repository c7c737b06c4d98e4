"""Text functions as Catalyst expressions. Lengths and places count code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip has it; the same class works in Java's and RE2's syntax.
SPACE = r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


#: The same characters, one after the other.
STRIPPED = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(STRIPPED))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def norm(text: Column) -> Column:
    """Stripped and in lower case; null is empty."""
    return F.lower(strip(F.coalesce(text, F.lit(""))))


def bilingual(zh: Column, en: Column) -> Column:
    """Both parts, stripped, as "zh / en"; one alone if the other is empty."""
    full = lambda x: F.nullif(strip(F.coalesce(x, F.lit(""))), F.lit(""))
    return F.concat_ws(" / ", full(zh), full(en))


def name_keys(name: Column, zh: Column, en: Column) -> Column:
    """Distinct normalised names: the whole one first, its parts in order, then zh and en."""
    whole = F.coalesce(name, F.lit(""))
    parts = F.transform(F.split(whole, r"[/|,;（）()]+"), norm)
    keys = F.concat(F.array(norm(whole)), parts, F.array(norm(zh), norm(en)))
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


def rfind(text: Column, sub: str) -> Column:
    """Place (from 0) of the last `sub` in text; null if there is none."""
    found = F.locate(sub[::-1], F.reverse(text))
    return F.when(found > 0, F.length(text) - found - len(sub) + 1)


def cut(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] for places from 0."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, SPACE + "+"), lambda w: w != ""))


def shortened(text: Column, n: int) -> Column:
    """The first n characters and "..." if there are more."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def halves(text: Column) -> tuple[Column, Column]:
    """First and last part of a bilingual text; a text of one part has an empty last."""
    parts = F.split(text, " / ")
    return F.element_at(parts, 1), F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(F.lit(""))


def comma_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), strip), lambda x: x != "")


def prompt_lines(text: Column) -> Column:
    """Stripped lines that aren't empty."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")


def lenient_json(text: Column, schema: str) -> Column:
    """The JSON value of a text; else of what lies from its first { to its last }; else null."""
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    valid = lambda x: F.when(F.get_json_object(x, "$").isNotNull(), F.from_json(x, schema))
    return F.coalesce(valid(text), valid(braces))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(?<=.)(\.[^.]+)$", 1))


def id_number(name: Column) -> Column:
    """7 of "symp-0007"; null where no number follows the first dash."""
    return F.get(F.split(name, "-"), F.lit(1)).try_cast("int")


def numbered_id(prefix: str, n: Column) -> Column:
    return F.format_string(f"{prefix}-%04d", n)


def short_id(*seed: Column) -> Column:
    """Eight hexadecimal digits as the id of a run: those of its seed, or new ones at each run of the plan."""
    return F.left(F.sha2(F.concat_ws("\x1f", *seed), 256) if seed else F.uuid(), F.lit(8))


def token_estimate(text: Column) -> Column:
    """Tokens of a text where no tokeniser is given: a quarter of its characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("int")
