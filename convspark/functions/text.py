"""Column helpers that reproduce Python string semantics with built-in Spark
expressions (no UDFs), so they stay inside whole-stage codegen.

Every helper takes and returns ``Column`` objects.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.strip()`` / ``str.split()`` treat
# as whitespace (``str.isspace``), written as a regex character class that
# both Java regex and RE2 accept.
PY_WS_CLASS = (
    r"[\t\n\x{0b}\x{0c}\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}"
    r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# Anchored at the absolute ends of the input (\A, \z), never at a line end.
_STRIP_RE = r"\A" + PY_WS_CLASS + r"+|" + PY_WS_CLASS + r"+\z"
_ALL_WS_RE = PY_WS_CLASS + "+"


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


_LEAD_RE = r"\A" + PY_WS_CLASS + r"+"


def py_strip(c) -> Column:
    """Python ``str.strip()`` (all Unicode whitespace, both ends).

    Most texts have no outer whitespace: only when the first or the last
    character is whitespace do we run the (linear) regex passes; the
    trailing run is removed by stripping the leading run of the reversed
    text, which avoids trying a match at every position."""
    x = col_of(c)
    ws_end = F.substr(x, F.lit(1), F.lit(1)).rlike(PY_WS_CLASS) | F.substr(x, F.lit(-1), F.lit(1)).rlike(PY_WS_CLASS)
    slow = F.reverse(F.regexp_replace(F.reverse(F.regexp_replace(x, _LEAD_RE, "")), _LEAD_RE, ""))
    return F.when(ws_end, slow).otherwise(x)


def py_is_blank(c) -> Column:
    """True when ``s.strip() == ''``; null input counts as blank."""
    return F.coalesce(F.length(py_strip(c)) == 0, F.lit(True))


def remove_ws(c) -> Column:
    """``''.join(s.split())``: drop every whitespace character."""
    return F.regexp_replace(col_of(c), _ALL_WS_RE, "")


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times in ``body`` (a lambda), so a
    costly sub-expression is not copied into every place it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


_JAVA_DOUBLE = r"^-?([0-9]+)\.([0-9]+)(?:E(-?[0-9]+))?$"


def py_float_repr(c) -> Column:
    """Render a double the way Python's ``repr(float)`` does.

    Spark's cast gives Java's ``Double.toString`` (``1.0E7``); Python prints
    fixed notation for 1e-4 <= |x| < 1e16 and ``1e+16`` style otherwise.
    The digits are the same, only the layout differs, so we re-layout them.
    """
    d = col_of(c).cast("double")

    def layout(r):
        digits, e, nd = r["digits"], r["e"], F.length(r["digits"])
        fixed_big = F.when(nd <= e + 1, F.concat(digits, F.repeat(F.lit("0"), e + 1 - nd), F.lit(".0"))) \
            .otherwise(F.concat(F.substr(digits, F.lit(1), e + 1), F.lit("."), F.substr(digits, e + 2)))
        fixed_small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
        sci = F.concat(F.substr(digits, F.lit(1), F.lit(1)),
                       F.when(nd > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(F.lit("")),
                       F.lit("e"), F.when(e < 0, F.lit("-")).otherwise(F.lit("+")),
                       F.when(F.abs(e) < 10, F.concat(F.lit("0"), F.abs(e).cast("string")))
                       .otherwise(F.abs(e).cast("string")))
        body = (F.when(digits == "0", F.lit("0.0"))
                .when((e >= 0) & (e < 16), fixed_big)
                .when((e < 0) & (e >= -4), fixed_small)
                .otherwise(sci))
        return F.concat(r["sign"], body)

    def parts(js):
        ip = F.regexp_extract(js, _JAVA_DOUBLE, 1)
        raw = F.concat(ip, F.regexp_extract(js, _JAVA_DOUBLE, 2))
        ex = F.coalesce(F.regexp_extract(js, _JAVA_DOUBLE, 3).try_cast("int"), F.lit(0))
        digits = F.coalesce(F.nullif(F.regexp_replace(raw, "^0+|0+$", ""), F.lit("")), F.lit("0"))
        e = (ex + F.length(ip) - 1 - F.length(F.regexp_extract(raw, "^(0*)", 1))).cast("int")
        sign = F.when(F.startswith(js, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
        return let(F.struct(digits.alias("digits"), e.alias("e"), sign.alias("sign")), layout)

    return (
        F.when(d.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(d), F.lit("nan"))
        .when(d == float("inf"), F.lit("inf"))
        .when(d == float("-inf"), F.lit("-inf"))
        .otherwise(let(d.cast("string"), parts))
    )
