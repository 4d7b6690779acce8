"""Bytes, hex and bit text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bytes_to_hex(data: Column) -> Column:
    """Lower-case hex; null and empty give the empty string."""
    return F.coalesce(F.lower(F.hex(data)), F.lit(""))


def bit_text(data: Column) -> Column:
    """``0``/``1`` text, most significant bit of each byte first."""
    digits = F.split(F.hex(data), "")
    nibble = lambda d: F.lpad(F.conv(d, 16, 2), 4, "0")
    return F.when(F.octet_length(data) == 0, F.lit("")).otherwise(F.array_join(F.transform(F.filter(digits, lambda d: d != ""), nibble), ""))


def hex_to_binary(hex_text: Column) -> Column:
    """Bits of hex text with every byte reversed: least significant bit first."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(hex_text) - 1, F.lit(1)), F.lit(2)), lambda i: F.substring(hex_text, i, F.lit(2)))
    bits = F.array_join(F.transform(pairs, lambda h: F.reverse(F.lpad(F.conv(h, 16, 2), 8, "0"))), "")
    return F.when(F.length(hex_text) < 2, F.lit("")).otherwise(bits)


def freq_to_channel(freq: Column) -> Column:
    """Channel text of a frequency: 1 to 14 in the 2.4 GHz band, else the text unchanged."""
    f = freq.try_cast("int")
    low = f.between(2412, 2472) & ((f - 2412) % 5 == 0)
    return F.when(low, ((f - 2412) / 5 + 1).cast("int").cast("string")).when(f == 2484, "14").otherwise(freq)


def frequency_to_channel(freq: Column) -> Column:
    """The arithmetic channel number, in every band."""
    return ((freq.cast("int") - 2407) / 5).cast("int")


def pad_array(values: Column, length: int) -> Column:
    """An array cut or filled with nulls to ``length``; null gives nulls only."""
    nulls = F.array_repeat(F.lit(None), length)
    return F.slice(F.when(values.isNull(), nulls).otherwise(F.concat(values, nulls)), 1, length)


def u_to_zero(bits: Column) -> Column:
    """Unknown symbols read as zero."""
    return F.translate(bits, "U", "0")


def ascii_sum(text: Column, strip: str = "") -> Column:
    """Sum of the byte values of hex text, two digits at a time.

    A trailing single digit counts by itself, empty text gives 0, any other
    symbol gives null. ``strip`` names symbols to take out first.
    """
    text = F.translate(text, strip, "") if strip else text
    chunks = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(2)), lambda i: F.conv(F.substring(text, i, F.lit(2)), 16, 10).cast("long"))
    total = F.aggregate(chunks, F.lit(0).cast("long"), lambda a, b: a + b)
    return F.when(text == "", F.lit(0).cast("long")).when(text.rlike("^[0-9a-fA-F]*$"), total)
