"""Text helpers: blank tests, UTF-16 lengths, stable identifiers, strict JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Plain JSON only: no single quotes, no NaN or Infinity.
STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}

# Control characters and the space.
BLANKS = "".join(map(chr, range(0x21)))

# Control and Unicode spaces, line and paragraph ends, and the byte order mark.
WHITESPACE = "\t\n\v\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def is_blank(value: Column) -> Column:
    """Null, empty, or nothing but control characters and spaces."""
    may_be = F.substring(value, 1, 1) <= " "  # settles nearly all values without trimming
    return value.isNull() | (may_be & (F.btrim(value, F.lit(BLANKS)) == ""))


def is_empty(value: Column) -> Column:
    return value.isNull() | (value == "")


def utf16_length(value: Column) -> Column:
    """Length in UTF-16 units, the unit in which length limits are stated."""
    return (F.octet_length(F.encode(value, "UTF-16BE")) / 2).cast("int")


def utf16_prefix(value: Column, units: int) -> Column:
    """The first ``units`` UTF-16 units, less one where they would end inside a character."""
    coded = F.encode(value, "UTF-16BE")
    inside = F.hex(F.substring(coded, 2 * units - 1, 1)).between("D8", "DB")
    whole = F.when(inside, F.lit(2 * units - 2)).otherwise(F.lit(2 * units))
    return F.when(F.octet_length(coded) <= 2 * units, value).otherwise(F.decode(F.substring(coded, F.lit(1), whole), "UTF-16BE"))


def stable_uuid(*parts: Column) -> Column:
    """UUID-shaped id derived from its inputs, so that a re-run gives the same id."""
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    spans = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in spans])


def is_uuid(value: Column) -> Column:
    return value.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sole_json_value(value: Column) -> Column:
    """The JSON value in ``value``, or null if it is malformed or followed by anything.

    ``from_json`` stops after the first value. Wrapping the text in an array
    whose second element is a known number makes leftovers visible.
    """

    def unwrap(text: Column) -> Column:
        mark = F.length(text).cast("string")
        wrapped = F.from_json(F.concat(F.lit("["), text, F.lit(","), mark, F.lit("]")), "array<string>", STRICT_JSON)
        return once(wrapped, lambda w: F.when((F.size(w) == 2) & (F.get(w, F.lit(1)) == mark), F.get(w, F.lit(0))))

    return once(value, unwrap)


def trim_whitespace(value: Column) -> Column:
    """Drop whitespace of any kind, line ends included, from both ends."""
    return F.btrim(value, F.lit(WHITESPACE))
