"""Names of enum values as identifiers: every character that an identifier can't have becomes ``_<hex codepoint>_``.

A leading digit is written so as well. One-digit codepoints are written with one digit and, as they
can't be told from ordinary text, are not decoded. ``compat`` decoding takes only the first four hex
digits of longer numbers, as files of older writers expect.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_ENCODED = re.compile(r"_([a-f0-9]{2,})_")


def encode_name(value: object) -> str:
    text = str(value)
    return "".join(c if c.isascii() and (c.isalpha() or (c.isdigit() and i)) else f"_{ord(c):x}_" for i, c in enumerate(text))


def decode_name(text: str, compat: bool = False) -> str:
    def char(m: re.Match) -> str:
        digits = m[1]
        if compat and len(digits) > 4:
            return chr(int(digits[:4], 16)) + digits[4:]
        code = int(digits, 16)
        return chr(code) if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else m[0]

    return _ENCODED.sub(char, text)


def encode(value: Column) -> Column:
    """encode_name of a string column; null stays null, empty stays empty."""
    chars = F.split(value, "")
    plain = lambda c, i: c.rlike("^[A-Za-z]$") | (c.rlike("^[0-9]$") & (i > 0))
    coded = F.transform(chars, lambda c, i: F.when(plain(c, i), c).otherwise(F.concat(F.lit("_"), F.lower(F.hex(F.ascii(c))), F.lit("_"))))
    return F.when(value == "", value).otherwise(F.array_join(coded, ""))


def decode(value: Column, compat: bool = False) -> Column:
    """decode_name of a string column."""
    parts = F.regexp_extract_all(value, F.lit("(?s)_[a-f0-9]{2,}_|."), F.lit(0))

    def text(part: Column) -> Column:
        digits = F.ltrim(F.substring(part, F.lit(2), F.length(part) - 2), F.lit("0"))
        raw = F.substring(part, F.lit(2), F.length(part) - 2)
        utf32 = lambda h: F.decode(F.unhex(F.lpad(h, 8, "0")), "UTF-32")
        legal = (F.length(digits) <= 6) & ~(digits.rlike("^d[89a-f]..$")) & ((F.length(digits) < 6) | digits.startswith("10"))
        fixed = F.when(legal, utf32(F.when(legal, digits).otherwise("20"))).otherwise(part)
        if compat:
            head = F.substring(raw, F.lit(1), F.lit(4))
            fixed = F.when(F.length(raw) > 4, F.concat(utf32(head), F.substring(raw, F.lit(5), F.length(raw)))).otherwise(fixed)
        return F.when(part.rlike("^_[a-f0-9]{2,}_$"), fixed).otherwise(part)

    return F.array_join(F.transform(parts, text), "")


def each(value: Column, f) -> Column:
    """f over the elements of an array column."""
    return F.transform(value, f)
