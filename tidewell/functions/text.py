"""Text measures, normal forms and claim checks as Columns."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import COVERAGE_FLOOR, ENOUGH_TERMS, STOP_WORDS
from .lazy import arrow

SPACE = r"(?U)\s+"


def collapse(text: Column) -> Column:
    """Runs of whitespace as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normal_query(query: Column) -> Column:
    return F.lower(collapse(query))


def query_set(queries: Column) -> Column:
    """Normal forms, sorted, without repeats."""
    return F.array_sort(F.array_distinct(F.transform(queries, normal_query)))


def terms(text: Column) -> Column:
    """Lower-case terms of two characters or more."""
    parts = F.split(text, r"[^\p{IsAlphabetic}\p{N}]+")
    return F.transform(F.filter(parts, lambda w: F.char_length(w) >= 2), lambda w: F.lower(w))


def query_terms(query: Column) -> Column:
    return F.array_except(F.array_distinct(terms(query)), F.array(*[F.lit(w) for w in STOP_WORDS]))


def coverage(queries: Column, title: Column, url: Column, snippet: Column) -> Column:
    """How well a hit covers the best of the queries' terms (array of arrays), from the floor to 1."""
    present = F.concat(terms(title), terms(url), terms(snippet))
    asked = F.filter(queries, lambda q: F.size(q) > 0)
    share = F.transform(asked, lambda q: F.least(F.size(F.array_intersect(q, present)) / F.least(F.size(q), F.lit(ENOUGH_TERMS)), F.lit(1.0)))
    return F.when(F.size(asked) == 0, F.lit(1.0)).otherwise(F.lit(COVERAGE_FLOOR) + F.lit(1.0 - COVERAGE_FLOOR) * F.array_max(share))


#: Markdown links and images.
LINK = r'!?\[([^\]]*)\]\([^)\s]*(?:\s+"[^"]*")?\)'
_FROM = "‘’‚‛′“”„‟″«»‐‑‒–—―−"
_TO = "'''''\"\"\"\"\"\"\"-------"
_GONE = "​‌‍⁠﻿­*_`\\"


def normal_text(text: Column) -> Column:
    """The form in which quotes are looked for on pages."""
    plain = F.translate(F.regexp_replace(text, LINK, "$1"), _FROM + _GONE, _TO)
    return F.lower(F.regexp_replace(collapse(plain), "…", "..."))


def plain_text(text: Column) -> Column:
    return collapse(F.regexp_replace(text, r"\\", ""))


TICKS = r"`([^`]+)`"
VERSION = r"(?U)\bv?(\d+(?:[.,]\d+)+)\b"
UNIT = r"(?iU)\b(\d+(?:[.,]\d+)*)\s?(?:%|(?:ns|µs|us|ms|s|secs?|seconds?|mins?|minutes?|h|hrs?|hours?|days?|weeks?|months?|years?|[kmgtp]i?b|bytes?|b|bits?|chars?|characters?|tokens?|lines?|px|[kmg]?hz|x)\b)"
CODE = r"(?U)\b[A-Z]{1,4}\d{3,5}\b"
NUMBER = r"(?U)\d+(?:[.,]\d+)*"


def claim_tokens(text: Column) -> Column:
    """struct(identifiers, numbers, codes) that a bullet states, each without repeats."""
    bare = F.regexp_replace(text, LINK, "")
    names = F.filter(F.transform(F.regexp_extract_all(bare, F.lit(TICKS), F.lit(1)), lambda x: F.regexp_replace(F.trim(x), r"\\", "")), lambda x: x != "")
    prose = F.regexp_replace(bare, TICKS, " ")
    numbers = F.concat(F.regexp_extract_all(prose, F.lit(VERSION), F.lit(1)), F.regexp_extract_all(prose, F.lit(UNIT), F.lit(1)))
    return F.struct(F.array_distinct(names).alias("identifiers"), F.array_distinct(numbers).alias("numbers"), F.array_distinct(F.regexp_extract_all(prose, F.lit(CODE), F.lit(0))).alias("codes"))


def groups(number: Column) -> Column:
    return F.filter(F.split(number, "[.,]"), lambda g: g != "")


def _whole(g: Column) -> Column:
    """The digits of one group or of thousands; null for others."""
    thousands = F.forall(F.slice(g, 2, 100), lambda x: F.length(x) == 3)
    return F.when((F.size(g) == 1) | ((F.size(g) > 1) & thousands), F.array_join(g, ""))


def numbers_match(claim: Column, page: Column) -> Column:
    """The same groups, the same value without thousands marks, or a version of which the claim is the front."""
    c, p = groups(claim), groups(page)
    front = (F.size(c) >= 2) & (F.slice(p, F.lit(1), F.size(c)) == c)
    return (c == p) | F.coalesce(_whole(c) == _whole(p), F.lit(False)) | front


def page_numbers(page: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(page, F.lit(NUMBER), F.lit(0)))


def identifier_on(page: Column, name: Column) -> Column:
    """The name itself, or the last part of a path-like one, on the page."""
    bare = F.regexp_replace(name, r"(\(\))+$", "")
    last = F.regexp_extract(bare, r"([^:./#]*)$", 1)
    return F.contains(page, name) | ((last != "") & (F.length(last) < F.length(bare)) & F.contains(page, last))


def page_forms(page: Column) -> Column:
    """struct(shown, bare, numbers, codes): the forms of a page that claims are tested on."""
    bare = plain_text(page)
    return F.struct(normal_text(page).alias("shown"), bare.alias("bare"), page_numbers(page).alias("numbers"), F.array_distinct(F.regexp_extract_all(bare, F.lit(CODE), F.lit(0))).alias("codes"))


def support_of(claim: Column, page: Column) -> Column:
    """none, partial or exact for a claim (wanted: its normalised quote, tokens) on page_forms."""
    tokens = claim["tokens"]
    all_ = (
        F.forall(tokens["identifiers"], lambda x: identifier_on(page["bare"], x))
        & F.forall(tokens["codes"], lambda x: F.array_contains(page["codes"], x))
        & F.forall(tokens["numbers"], lambda x: F.exists(page["numbers"], lambda n: numbers_match(x, n)))
    )
    found = (claim["wanted"] != "") & F.contains(page["shown"], claim["wanted"])
    return F.when(~F.coalesce(found, F.lit(False)), "none").when(all_, "exact").otherwise("partial")


def support(quote: Column, tokens: Column, page: Column) -> Column:
    """none, partial or exact: whether the quote stands on the page, and all that the bullet states too."""
    return support_of(F.struct(normal_text(quote).alias("wanted"), tokens.alias("tokens")), page_forms(page))


def challenge_page(html: Column, marks: list[str]) -> Column:
    head = F.lower(F.substring(html, 1, 20000))
    out = F.lit(False)
    for m in marks:
        out = out | F.contains(head, F.lit(m))
    return out


def human_size(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" bytes"))).otherwise(F.concat(F.floor((n + 512) / 1024).cast("string"), F.lit(" KB")))


@arrow("string")
def _fixed(value: pa.Array, digits: pa.Array) -> pa.Array:
    return pa.array([None if v is None else f"{v:.{d}f}" for v, d in zip(value.to_pylist(), digits.to_pylist(), strict=True)], pa.string())


def fixed(value: Column, digits: int) -> Column:
    """Decimal text of a double, rounded on its exact value with ties to even (the JVM rounds its shortest decimal form up)."""
    return _fixed(value.cast("double"), F.lit(digits))


def compact(n: Column) -> Column:
    """1234567 as 1.2M, 12345 as 12.3k, 850 as 850."""
    big = n >= 1_000_000
    return F.when(n < 1000, n.cast("string")).otherwise(F.concat(fixed(F.when(big, n / 1_000_000.0).otherwise(n / 1000.0), 1), F.when(big, "M").otherwise("k")))


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def clip(text: Column, most: int) -> Column:
    flat = F.regexp_replace(text, r"[\x00-\x1F\x7F-\x9F]", " ")
    return F.when(F.char_length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, max(0, most - 3)), F.lit("...")))


def short_duration(seconds: Column) -> Column:
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s"))).otherwise(F.concat(F.ceil(seconds / 60).cast("string"), F.lit("m")))


def capped(text: Column, most: int) -> Column:
    """At most so many characters, with a note of how many were left out."""
    n = F.char_length(text)
    return F.when(n <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("\n[truncated "), (n - most).cast("string"), F.lit(" chars]")))


def cache_key(provider: Column, query: Column, recency: Column, page: Column) -> Column:
    return F.concat_ws("\x01", provider, normal_query(query), F.coalesce(recency, F.lit("")), page.cast("string"))


def fnv1a(text: str) -> int:
    value = 0xCBF29CE484222325
    for b in text.encode():
        value = (value ^ b) * 0x100000001B3 & (1 << 64) - 1
    return value


@arrow("string")
def fnv1a_64(text: pa.Array) -> pa.Array:
    """FNV-1a of 64 bits in 16 hexadecimal digits."""
    return pa.array([None if x is None else f"{fnv1a(x):016x}" for x in text.to_pylist()], pa.string())


_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}


def without_tags(raw: str) -> str:
    """What stands outside < and >; a lone > is dropped, an open < drops the rest."""
    return re.sub(r"<[^>]*(?:>|$)|>", "", raw)


def _entity(m: re.Match) -> str:
    name = m[1]
    if name in _NAMED:
        return _NAMED[name]
    digits = re.fullmatch(r"#[xX]\s*\+?([0-9A-Fa-f]+)\s*", name) or re.fullmatch(r"#\s*\+?([0-9]+)\s*", name)
    if digits:
        code = int(digits[1], 16 if name[1:2] in "xX" else 10)
        if code < 0x110000 and not 0xD800 <= code < 0xE000:
            return chr(code)
    return m[0]


def decode_entities(raw: str) -> str:
    """Named and numeric entities of at most 32 bytes, then collapsed whitespace; unknown ones stay."""
    out, rest = [], raw
    while (at := rest.find("&")) >= 0:
        out.append(rest[:at])
        m = re.match(r"&([^;]*);", rest[at:])
        text = _entity(m) if m and len(m[1].encode()) <= 32 else None
        if text is None or text == m[0]:
            out.append("&")
            rest = rest[at + 1 :]
        else:
            out.append(text)
            rest = rest[at + len(m[0]) :]
    return " ".join(("".join(out) + rest).split())


@arrow("string")
def decode_html(text: pa.Array) -> pa.Array:
    """Text of an HTML fragment: tags out, entities decoded, whitespace collapsed."""
    return pa.array([None if x is None else decode_entities(without_tags(x)) for x in text.to_pylist()], pa.string())
