"""Tokenizing, stripping and rewriting of text columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Unicode white space plus the four ASCII information separators.
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Drop leading and trailing white space of any kind (``trim`` alone only drops blanks)."""
    return F.btrim(text, F.lit(WHITESPACE_CHARS))


def raw_words(text: Column) -> Column:
    """Split on runs of white space. An edge run leaves one empty string; filter it after the explode."""
    return F.split(text, WHITESPACE_RUN)


def words(text: Column) -> Column:
    """Split on runs of white space, never an empty word, case kept."""
    return F.array_remove(raw_words(text), "")


def space_tokens(line: Column) -> Column:
    """Split on every single blank: leading and inner empty tokens stay, trailing ones go.

    An empty line is one empty token; a line of blanks only has no token.
    """
    body = F.rtrim(line)
    return (
        F.when(line == "", F.array(F.lit("")))
        .when(body == "", F.array().cast("array<string>"))
        .otherwise(F.split(body, " "))
    )


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def call_style_prints(text: Column) -> Column:
    """Turn ``print x`` statement lines into ``print(x)``; indent and trailing white space are dropped.

    (?d) makes newline the only line end, so ``.`` and ``$`` do not stop at other separators.
    """
    return F.regexp_replace(text, r"(?dmU)^[ \t]*print (?=.)(.*?)[[^\S\n]\x1c-\x1f]*$", "print($1)")


def python3_shebang(text: Column) -> Column:
    """Point an ``env python`` or ``env python2`` interpreter on the first line to python3."""
    return F.regexp_replace(text, r"\A([^\n]*?/usr/bin/env python)2?(?![0-9])", r"$1\3")


def escape_quotes(text: Column) -> Column:
    return F.replace(text, F.lit('"'), F.lit('\\"'))
