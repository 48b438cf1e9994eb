"""Java literals as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_MAX, INT_MIN, LONG_MAX, LONG_MIN = (1 << 31) - 1, -(1 << 31), (1 << 63) - 1, -(1 << 63)


def int_literal(value: Column, hexadecimal: bool = True) -> Column:
    if not hexadecimal:
        return value.cast("string")
    v = value.cast("bigint")
    bits = F.right(F.concat(F.lit("0000000"), F.lower(F.hex(v))), F.lit(8))
    text = F.when(v < 0, F.concat(F.lit("0x"), bits)).otherwise(F.concat(F.lit("0x"), F.lower(F.hex(v))))
    return F.when(v == INT_MAX, "Integer.MAX_VALUE").when(v == INT_MIN, "Integer.MIN_VALUE").otherwise(text)


def long_literal(value: Column, hexadecimal: bool = True) -> Column:
    v = value.cast("bigint")
    if not hexadecimal:
        return F.concat(v.cast("string"), F.lit("L"))
    return F.when(v == LONG_MAX, "Long.MAX_VALUE").when(v == F.lit(LONG_MIN), "Long.MIN_VALUE").otherwise(F.concat(F.lit("0x"), F.lower(F.hex(v)), F.lit("L")))


def double_literal(value: Column) -> Column:
    """Names for the special values, exponents below 1e-4 and from 1e7 on, a fraction always, and the suffix."""
    v = value.cast("double")
    raw = v.cast("string")  # d.ddd or d.dddE±n
    size = F.abs(v)
    plain = F.when((v != 0) & ((size < 1e-4) | (size >= 1e7)), F.lower(raw))
    # below a thousandth the text has an exponent where digits are wanted
    digits = F.regexp_replace(F.format_string("%.25f", v), r"0+$", "")
    text = F.coalesce(plain, F.when((v != 0) & (size < 1e-3), digits).otherwise(raw))
    special = F.when(F.isnan(v), "Double.NaN").when(v == float("inf"), "Double.POSITIVE_INFINITY").when(v == float("-inf"), "Double.NEGATIVE_INFINITY")
    return special.when(v == 1.7976931348623157e308, "Double.MAX_VALUE").when(v == 4.9e-324, "Double.MIN_VALUE").when(v == 2.2250738585072014e-308, "Double.MIN_NORMAL").otherwise(F.concat(text, F.lit("d")))


def _escaped(text: Column, escape_unicode: bool) -> Column:
    out = text
    for plain, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\x00", "\\0")):
        out = F.replace(out, F.lit(plain), F.lit(code))
    odd = r"[\x01-\x1f\x7f]" if not escape_unicode else r"[\x01-\x1f\x7f-\x{10FFFF}]"

    def code_units(c: Column) -> Column:
        raw = F.lower(F.hex(F.encode(c, "UTF-16BE")))
        return F.concat(F.lit("\\u"), F.substring(raw, 1, 4), F.when(F.length(raw) > 4, F.concat(F.lit("\\u"), F.substring(raw, 5, 4))).otherwise(F.lit("")))

    each = F.array_join(F.transform(F.regexp_extract_all(out, F.lit("(?s)."), F.lit(0)), lambda c: F.when(c.rlike(odd), code_units(c)).otherwise(c)), "")
    return F.when(out.rlike(odd), each).otherwise(out)


def string_literal(text: Column, escape_unicode: bool = True) -> Column:
    """A quoted Java string; beyond ASCII as \\u escapes if asked, supplementary characters as two."""
    return F.concat(F.lit('"'), _escaped(text, escape_unicode), F.lit('"'))


def char_literal(code: Column, escape_unicode: bool = True) -> Column:
    """A quoted Java character of a UTF-16 code unit: a single quote is escaped, a double one is not."""
    c = F.decode(F.unhex(F.lpad(F.hex(code.cast("int")), 4, "0")), "UTF-16BE")
    body = F.when(code == 39, F.lit("\\'")).when(code == 34, F.lit('"')).when(code.between(0xD800, 0xDFFF), F.concat(F.lit("\\u"), F.lower(F.hex(code.cast("int"))))).otherwise(_escaped(c, escape_unicode))
    return F.concat(F.lit("'"), body, F.lit("'"))


def float_literal(value: Column) -> Column:
    """double_literal() of a 32-bit value, with its own limits, its shortest digits and its suffix."""
    v = value.cast("float")
    raw, size = v.cast("string"), F.abs(v)
    plain = F.when((v != 0) & ((size < 1e-4) | (size >= 1e7)), F.lower(raw))
    # 1.0E-4 to 9.99E-4 print with an exponent where digits are wanted
    digits = F.regexp_replace(F.format_string("%.15f", raw.cast("double")), r"0+$", "")
    text = F.coalesce(plain, F.when((v != 0) & (size < 1e-3), digits).otherwise(raw))
    special = F.when(F.isnan(v), "Float.NaN").when(v == float("inf"), "Float.POSITIVE_INFINITY").when(v == float("-inf"), "Float.NEGATIVE_INFINITY")
    most, least, normal = (F.lit(x).cast("float") for x in (3.4028234663852886e38, 1.401298464324817e-45, 1.1754943508222875e-38))
    return special.when(v == most, "Float.MAX_VALUE").when(v == least, "Float.MIN_VALUE").when(v == normal, "Float.MIN_NORMAL").otherwise(F.concat(text, F.lit("f")))
