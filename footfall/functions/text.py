"""Text helpers with the white-space and length rules of the browser side."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the characters that the browser's trim() and \s regard as white space.
SPACES = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def compact(text: Column) -> Column:
    """Trimmed text, NULL where nothing is left."""
    return F.nullif(trimmed(text), F.lit(""))


def one_spaced(text: Column) -> Column:
    return F.regexp_replace(trimmed(text), f"[{SPACES}]+", " ")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, which is what the browser side counts."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def parse_list(text: Column) -> Column:
    """Items separated by line ends or commas, trimmed, blanks left out.

    The carriage return of a line end is white space, so trimming takes it off.
    """
    return F.array_remove(F.transform(F.split(text, r"[\n,]"), trimmed), "")


def grouped_digits(number: Column) -> Column:
    return F.format_number(number, 0)


def or_dash(text: Column) -> Column:
    return F.coalesce(text, F.lit("-"))
