"""Number and string text that equals what Python prints, without Python.

Run logs are hashed and compared as text, so a fixed-point number, a float
and a JSON string must come out character for character as the tools that
wrote the logs print them.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_FRACTION_BITS = 52


def fixed(x: Column, digits: int) -> Column:
    """Fixed-point text, rounded half-to-even on the exact binary value.

    ``format_string`` rounds the shortest decimal text half-up instead, which
    differs on ties such as 0.125 and on near-ties such as 0.15. The fraction
    is scaled by a power of two (exact), so the comparison with one half is
    done on integers. Valid for magnitudes below 2^53 and up to 3 digits.
    """
    if digits == 0:
        return F.rint(x).cast("long").cast("string")
    scale = 10 ** digits
    half = 1 << (_FRACTION_BITS - 1)
    magnitude = F.abs(x)
    whole = F.floor(magnitude).cast("long")
    scaled = (magnitude - whole) * F.lit(float(1 << _FRACTION_BITS))
    bits = F.floor(scaled).cast("long")
    product = bits * F.lit(scale)
    digits_down = F.shiftright(product, _FRACTION_BITS)
    rest = product - F.shiftleft(digits_down, _FRACTION_BITS)
    # bits of a value below 1 that lie under 2^-52
    below = (scaled - bits) * F.lit(float(scale))
    gap = (F.lit(half) - rest).cast("double")
    up = (below > gap) | ((below == gap) & (digits_down % 2 == 1))
    rounded = digits_down + F.when(up, F.lit(1)).otherwise(F.lit(0))
    carry = F.when(rounded >= scale, F.lit(1)).otherwise(F.lit(0))
    return F.concat(
        F.when(F.signum(x) < 0, F.lit("-")).otherwise(F.lit("")),
        (whole + carry).cast("string"), F.lit("."),
        F.lpad((rounded % scale).cast("string"), digits, "0"))


def python_float(x: Column) -> Column:
    """Text of a double as Python's ``repr`` writes it.

    Both print the shortest digits; they differ in when the exponent form
    starts (Python: below 1e-4 and from 1e16; the JVM: below 1e-3 and from
    1e7) and in its spelling (``1e-05`` against ``1.0E-5``).
    """
    text = x.cast("string")
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    body = F.regexp_replace(text, "^-", "")
    mantissa = F.regexp_replace(F.substring_index(body, "E", 1), r"\.0$", "")
    exponent = F.substring_index(body, "E", -1).try_cast("int")
    digits = F.regexp_replace(mantissa, r"\.", "")
    as_exponent = F.concat(
        mantissa, F.lit("e"),
        F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+")),
        F.when(F.abs(exponent) < 10, F.lit("0")).otherwise(F.lit("")),
        F.abs(exponent).cast("string"))
    # exponents 7..15: move the point to the right
    length = F.length(digits)
    whole = F.rpad(digits, exponent + 1, F.lit("0"))
    as_plain = F.when(
        length > exponent + 1,
        F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."),
                 F.substring(digits, exponent + 2, length)),
    ).otherwise(F.concat(whole, F.lit(".0")))
    return (
        F.when(F.isnan(x), F.lit("nan"))
        .when(body == "Infinity", F.concat(sign, F.lit("inf")))
        .when(~body.contains("E"), text)
        .when(exponent == -4, F.concat(sign, F.lit("0.000"), digits))
        .when((exponent >= 0) & (exponent < 16), F.concat(sign, as_plain))
        .otherwise(F.concat(sign, as_exponent)))


def json_number(x: Column) -> Column:
    """A double in JSON text; non-finite values keep their bare names."""
    plain = python_float(x)
    return (F.when(plain == "nan", F.lit("NaN"))
            .when(plain == "inf", F.lit("Infinity"))
            .when(plain == "-inf", F.lit("-Infinity"))
            .otherwise(plain))


def json_ascii_string(s: Column) -> Column:
    """A JSON string literal in which everything outside ASCII is escaped."""
    short = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r",
             "\t": "\\t", "\f": "\\f", "\b": "\\b"}

    def escape(c: Column) -> Column:
        units = F.lower(F.hex(F.encode(c, "UTF-16BE")))
        out = F.concat(F.lit("\\u"), F.substring(units, 1, 4))
        out = F.when(F.length(units) > 4, F.concat(
            out, F.lit("\\u"), F.substring(units, 5, 4))).otherwise(out)
        out = F.when(c.rlike("^[ -~]$"), c).otherwise(out)
        for raw, text in short.items():
            out = F.when(c == raw, F.lit(text)).otherwise(out)
        return out

    plain = s.rlike(r'^[ !#-\[\]-~]*$')
    escaped = F.array_join(F.transform(F.split(s, ""), escape), "")
    return F.concat(F.lit('"'), F.when(plain, s).otherwise(escaped), F.lit('"'))


def python_quoted(s: Column) -> Column:
    """A short name in the quotes Python's ``repr`` would choose."""
    body = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")),
                     F.lit("\n"), F.lit("\\n"))
    single, double = s.contains("'"), s.contains('"')
    return (F.when(single & ~double, F.concat(F.lit('"'), body, F.lit('"')))
            .otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")),
                                F.lit("'"))))
