"""Projection-level text functions; all run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: letters and digits, with single joiners between them.
TOKEN = r"[\p{IsAlphabetic}\p{Nd}]+(?:[-'`_][\p{IsAlphabetic}\p{Nd}]+)*"
GARBAGE = r"[^\p{IsAlphabetic}'`-]"
#: Code points whose lower case depends on what follows, or has two code points.
SPECIAL_UPPER, SPECIAL_LOWER = "\u03a3\u0130", "\u03c3i"
LANGUAGE_MARK, EXACT_MARK = "|", "!"


def normalize(text: Column | str) -> Column:
    """Lower case by code point: each gives one, whatever stands beside it."""
    text = F.col(text) if isinstance(text, str) else text
    for upper, lower in zip(SPECIAL_UPPER, SPECIAL_LOWER, strict=True):  # translate would look up each character
        text = F.replace(text, F.lit(upper), F.lit(lower))
    return F.lower(text)


def tokens(text: Column | str, lower: bool = True) -> Column:
    """The words of a text in order; null gives null."""
    return F.regexp_extract_all(normalize(text) if lower else text, F.lit(TOKEN), F.lit(0))


def valid_text(data: Column | str) -> Column:
    """Bytes as text; the empty text if they aren't UTF-8. Null stays null."""
    data = F.col(data) if isinstance(data, str) else data
    return F.when(data.isNotNull(), F.coalesce(F.try_validate_utf8(data.cast("string")), F.lit("")))


def is_garbage(word: Column | str) -> Column:
    """Whether a word has anything but letters, hyphens, apostrophes and backticks; such words aren't analysed."""
    return (F.col(word) if isinstance(word, str) else word).rlike(GARBAGE)


def byte_length(text: Column | str) -> Column:
    return F.octet_length(text).cast("long")


def strip_line(text: Column | str) -> Column:
    """Without blanks, tabs and line ends on both sides."""
    return F.btrim(text, F.lit(" \t\r\n"))


def split_docs(text: Column | str, delimiters: str) -> Column:
    """The non-empty pieces between any of the delimiter characters, in order."""
    pieces = F.split(text, "[" + re.sub(r"([\\\]\[^&-])", r"\\\1", delimiters) + "]", -1)
    return F.filter(pieces, lambda p: p != "")


def pack_annotation(model_no: Column, flexion_length: Column, base_length: Column) -> Column:
    """model << 16 | flexion length << 8 | base length, in upper-case base 36."""
    code = F.shiftleft(model_no.cast("long"), 16) + F.shiftleft(flexion_length.cast("long"), 8) + base_length.cast("long")
    return F.conv(code, 10, 36)


def unpack_annotation(code36: Column) -> Column:
    """struct(model_no, flex_len, base_len) of pack_annotation's text."""
    code = F.conv(code36, 36, 10).cast("long")
    part = lambda shift: F.shiftright(code, shift).bitwiseAND(F.lit(255))
    return F.struct(F.shiftright(code, 16).cast("int").alias("model_no"), part(8).cast("int").alias("flex_len"), part(0).cast("int").alias("base_len"))


def parse_phrase(line: Column | str) -> Column:
    """struct(lang, exact, text) of `[lang|][!]text`; lang is null without a mark, and may be empty."""
    line = F.col(line) if isinstance(line, str) else line
    at = F.instr(line, LANGUAGE_MARK)
    lang = F.when(at > 0, F.substring_index(line, LANGUAGE_MARK, 1))
    rest = F.when(at > 0, F.substring(line, at + 1, F.length(line))).otherwise(line)
    exact = rest.startswith(EXACT_MARK)
    return F.struct(lang.alias("lang"), exact.alias("exact"), F.when(exact, F.substring(rest, F.lit(2), F.length(rest))).otherwise(rest).alias("text"))


def phrase_lines(phrase: Column | str) -> Column:
    """The stripped non-empty lines of a phrase text."""
    return F.filter(F.transform(F.split(phrase, "\n", -1), strip_line), lambda p: p != "")
