"""Locale numbers, tax ids, cell addresses, units and truncating money arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNREADABLE = "REVISAR"  # fixed value: marker written when a field could not be read
EMU_PER_INCH = 914400
PIXELS_PER_INCH = 96
POINTS_PER_INCH = 72


def _absent(c: Column) -> Column:
    return c.isNull() | (c == "") | (c == UNREADABLE)


def parse_es_number(c: Column) -> Column:
    """``1.234,56`` to decimal; empty or unreadable text gives null."""
    plain = F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(~_absent(c), plain.try_cast("decimal(18,2)"))


def format_es_number(c: Column) -> Column:
    """Decimal to ``1.234,56``; null gives an empty text."""
    return F.coalesce(F.translate(F.format_number(c, 2), ",.", ".,"), F.lit(""))


def parse_es_date(c: Column) -> Column:
    """``DD/MM/YYYY`` to date; empty or unreadable text gives null."""
    return F.when(~_absent(c), F.try_to_timestamp(c, F.lit("dd/MM/yyyy")).cast("date"))


def tax_id(c: Column) -> Column:
    """Drop a leading ``ES``; other country prefixes stay."""
    return F.regexp_replace(c, "^ES", "")


def column_letters(n: Column) -> Column:
    """1-based column number to letters (64 is BL); three letters cover every sheet."""
    letter = lambda k: F.char(F.lit(65) + k)
    n = n.cast("long")
    low = F.pmod(n - 1, F.lit(26))
    mid = F.floor((n - 1) / 26)
    high = F.floor((mid - 1) / 26)
    return F.concat(
        F.when(high > 0, letter(high - 1)).otherwise(F.lit("")),
        F.when(mid > 0, letter(F.pmod(mid - 1, F.lit(26)))).otherwise(F.lit("")),
        letter(low))


def column_number(letters: Column) -> Column:
    """Letters to 1-based column number."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0).cast("long"),
                       lambda acc, ch: F.when(ch == "", acc).otherwise(acc * 26 + F.ascii(ch) - 64))


def inches(emu: Column) -> Column:
    """EMU to inches as an exact decimal."""
    return emu.cast("decimal(20,0)") / F.lit(EMU_PER_INCH).cast("decimal(10,0)")


def inches_2(emu: Column) -> Column:
    """EMU to inches, rounded half-even to two places."""
    return F.bround(inches(emu), 2).cast("decimal(18,2)")


def pixels(inch: Column) -> Column:
    """Inches to whole pixels (cut, not rounded)."""
    return (inch * PIXELS_PER_INCH).cast("int")


def points_to_pixels(pt: Column) -> Column:
    return pt * PIXELS_PER_INCH / POINTS_PER_INCH


def cut(c: Column, places: int) -> Column:
    """Truncate a decimal towards zero, the way ``scale`` works in a desk calculator."""
    unit = F.lit(10 ** places)
    whole = F.when(c < 0, F.ceil(c * unit)).otherwise(F.floor(c * unit))
    return (whole.cast("decimal(30,0)") / unit.cast("decimal(10,0)")).cast(f"decimal(28,{places})")
