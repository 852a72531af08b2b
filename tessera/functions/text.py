"""Text functions: Column to Column, all inside the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .domain import ABBREVIATIONS, FIELDS, PROMPT, REQUIRED, STOP_WORDS

#: What Python's ``str.strip`` removes at both ends; ``trim`` alone removes U+0020.
ENDS = "".join(map(chr, (*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(ENDS))


def is_blank(c: Column) -> Column:
    """Nothing is left of it. A text that begins with a visible ASCII character is told by that, unstripped."""
    return ~F.substring(c, 1, 1).between("!", "~") & (strip(c) == "")


def _plain(ch: str) -> str:
    """The compatibility decomposition without combining marks."""
    return "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))


def _letters(text: str) -> bool:
    """Does it hold a letter A-Z or a digit, once in upper case?"""
    return any(x.isascii() and x.isalnum() for x in text.upper())


@lru_cache(1)
def _folds() -> tuple[str, str, dict[str, str]]:
    """For ``translate``: characters that fold to one other, these, and last those that vanish; and the characters that
    fold to several. Beyond the Latin blocks only folds with a letter A-Z or a digit, as ``normalize`` keeps no others."""
    one, gone, many = {}, [], {}
    for code in [*range(0x80, 0xD800), *range(0xE000, 0x110000)]:
        ch = chr(code)
        plain = _plain(ch)
        if plain == ch:
            continue
        if not plain:
            gone.append(ch)
        elif len(plain) == 1 and (code < 0x250 or 0x1E00 <= code < 0x1F00 or _letters(plain)):
            one[ch] = plain
        elif _letters(plain):
            many[ch] = plain
    return "".join(one) + "".join(gone), "".join(one.values()), many


def fold(c: Column) -> Column:
    """NFKD without combining marks, as far as the Latin script and letters A-Z and digits come out of it: ligatures,
    fractions, full-width and circled forms too. ASCII texts pass untouched."""
    old, new, many = _folds()
    table = F.str_to_map(F.lit("\n".join(f"{k}\t{v}" for k, v in many.items())), F.lit("\n"), F.lit("\t"))
    # A class of few ranges that holds them all: Java tries each member of a class in turn.
    several = F.array_distinct(F.regexp_extract_all(c, F.lit("([\u00bc-\u00be\u0130-\U0010ffff])"), 1))
    spelt = F.when(F.size(several) > 0, F.aggregate(several, c, lambda text, ch: F.replace(text, ch, F.coalesce(F.try_element_at(table, ch), ch)))).otherwise(c)
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(spelt, old, new)).otherwise(c)


def normalize(c: Column) -> Column:
    """Without accents, upper case, anything but A-Z and 0-9 one space, trimmed."""
    return F.trim(F.regexp_replace(F.upper(fold(c)), "[^A-Z0-9]+", " "))


def tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda t: t != "")


def _long_form(t: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    t = F.coalesce(F.try_element_at(known, t), t)
    return F.when(t.startswith("SEXTAVAD"), "SEXTAVADO").otherwise(t)


def _telling(t: Column) -> Column:
    return ~t.isin(*STOP_WORDS) & ~t.rlike("^[0-9]+$")


def word_tokens(normalized: Column) -> Column:
    """Distinct words: abbreviations written out, stop words and numbers left out."""
    inches = lambda t: F.when(t.startswith("POLEGAD"), "POLEGADA").otherwise(t)
    return F.array_distinct(F.filter(F.transform(tokens(normalized), lambda t: inches(_long_form(t))), _telling))


def numeric_tokens(normalized: Column) -> Column:
    """Distinct runs of digits, also those next to letters, as text."""
    return F.array_distinct(F.regexp_extract_all(normalized, F.lit("([0-9]+)"), 1))


def category_token(normalized: Column) -> Column:
    """The first word that tells something; empty, if none."""
    return F.coalesce(F.get(F.filter(F.transform(tokens(normalized), _long_form), _telling), F.lit(0)), F.lit(""))


def full_description(short: Column, long: Column) -> Column:
    return strip(F.concat(short, F.lit(" "), long))


def completeness(available: list[str], required: tuple[str, ...] = REQUIRED) -> Column:
    """Share of the required fields that are filled; a name that is no column counts as unfilled."""
    if not required:
        raise ValueError("required_fields não pode ser vazio")
    filled = [(~is_blank(F.col(f))).cast("int") if f in available else F.lit(0) for f in required]
    total = filled[0]
    for x in filled[1:]:
        total = total + x
    return total / F.lit(len(required)).cast("double")


def prompt() -> Column:
    """The deterministic prompt of a material row."""
    lines = [F.lit(x) for x in PROMPT] + [F.concat(F.lit(f"{f}: "), F.col(f)) for f in FIELDS]
    return F.concat_ws("\n", *lines)


_OFFSET = r"(Z|[+-]\d\d(?::?\d\d(?::?\d\d)?)?)"
#: Extended and basic form, any one character between date and time; week dates are not taken.
EXTENDED = rf"^\d{{4}}-\d\d-\d\d.\d\d:\d\d(:\d\d([.,]\d+)?)?{_OFFSET}$"
BASIC = rf"^(\d{{4}})(\d\d)(\d\d).(\d\d)(\d\d)(\d\d(?:[.,]\d+)?)?{_OFFSET}$"


def offset_time(raw: Column) -> Column:
    """The instant of an ISO 8601 text with an offset; null, if it has none or is no time."""
    spelt = F.regexp_replace(F.regexp_replace(raw, BASIC, "$1-$2-$3T$4:$5:$6$7"), r":([Z+-])", "$1")
    form = F.when(raw.rlike(EXTENDED), F.concat(F.substring(raw, 1, 10), F.lit("T"), F.substring(raw, 12, 100))).when(raw.rlike(BASIC), spelt)
    # Seconds may be left out, but not below. The form is named once, as each mention of it is computed anew.
    form = F.regexp_replace(form, "^(.{16})(?!:)", "$1:00")
    spelt = F.try_to_timestamp(F.replace(form, F.lit(","), F.lit(".")))
    # What most are, a time in UTC to the second, needs no pattern.
    usual = F.translate(raw, "123456789", "000000000") == "0000-00-00T00:00:00+00:00"
    return F.when(usual, F.try_to_timestamp(raw)).otherwise(spelt)
