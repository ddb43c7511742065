"""Reusable column expressions: numbers, text, identifiers and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelsight.session import sql_literal

NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
JUNK_NAMES = ["", "#n/a", "n/a", "na", "nan", "0", "none", "null", "-", "0.0"]


def text(c: Column) -> Column:
    """Trimmed text, '' for null."""
    return F.coalesce(F.trim(c.cast("string")), F.lit(""))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def to_number(c: Column, kind: T.DataType | None = None) -> Column:
    """Lenient number: null unless the whole cell is numeric. Typed numbers just cast."""
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    s = c.cast("string")
    return F.when(s.rlike(NUMBER), F.trim(s).try_cast("double"))


def to_money(c: Column) -> Column:
    """Lenient amount: thousands separators, currency signs and blanks are ignored."""
    return to_number(F.regexp_replace(c.cast("string"), r"[,₹\s]", ""))


def cents(c: Column) -> Column:
    """Amount as a whole number of paise, half away from zero."""
    return (F.signum(c) * F.floor(F.abs(c) * 100 + 0.5)).cast("bigint")


def rounded(c: Column, digits: int = 1) -> Column:
    """Decimal rounding that gives the same double in every engine."""
    scale = float(10 ** digits)
    return F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return ratio(part, whole) * 100.0


def rupees(paise: Column) -> Column:
    return paise.cast("double") / 100.0


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")


def norm_pincode(c: Column) -> Column:
    """'560037.0' -> '560037'; text that is no number is kept trimmed."""
    s = text(c)
    whole = F.when(s.rlike(NUMBER), s.try_cast("double").try_cast("bigint").cast("string"))
    return F.coalesce(whole, s)


def norm_awb(c: Column) -> Column:
    return F.regexp_replace(F.upper(text(c)), r"\.0$", "")


def norm_order(c: Column) -> Column:
    """Canonical order id: no leading '#', nothing from the first '_' on, upper case."""
    s = F.regexp_replace(text(c), "^#", "")
    return F.upper(F.trim(F.regexp_replace(s, r"(?s)_.*$", "")))


def norm_header(c: Column) -> Column:
    """Header cell for matching: lower case, no bracketed units, single blanks."""
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[\n₹]", " ")
    s = F.regexp_replace(s, r"\(.*?\)", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def title_case(c: Column) -> Column:
    return F.initcap(c)


def clean_city(c: Column) -> Column:
    return title_case(F.regexp_replace(text(c), r"\s+", " "))


def clean_name(c: Column) -> Column:
    s = text(c)
    return F.when(F.lower(s).isin(JUNK_NAMES), F.lit("")).otherwise(s)


def unwrap_formula(c: Column) -> Column:
    """Spreadsheet text formulas: '="123"' -> '123'."""
    s = F.regexp_replace(text(c), "^=", "")
    return F.trim(F.regexp_replace(F.trim(s), '^"+|"+$', ""))


def first_word(c: Column) -> Column:
    """First token of a courier name in title case."""
    return title_case(F.regexp_extract(text(c), r"^[^ _\-/]*", 0))


def split_skus(c: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[,/|]"), lambda t: F.trim(t))
    return F.filter(parts, lambda t: t != "")


def bracketed_skus(c: Column) -> Column:
    """'[a1] {Name} [b2]' -> 'A1, B2'."""
    found = F.regexp_extract_all(text(c), F.lit(r"\[([^\]]+)\]"), 1)
    return F.array_join(F.transform(found, lambda t: F.upper(F.trim(t))), ", ")


def braced_name(c: Column) -> Column:
    return clean_name(F.regexp_extract(text(c), r"\{([^}]+)\}", 1))


def contains_any_sql(column: str, tokens) -> str:
    """SQL condition: the column holds any of the tokens."""
    return "(" + " OR ".join(f"contains({column}, {sql_literal(t)})" for t in tokens) + ")"


def constant_array(values: list) -> Column:
    return F.expr("array(" + ", ".join(sql_literal(v) for v in values) + ")")


def pick(index: Column, values: list) -> Column:
    """Value at a zero-based index of a constant list; null for a null index."""
    return F.get(constant_array(values), index)


def lookup(column: str, table: dict) -> Column:
    """Value of a small constant mapping; null for an absent key."""
    by_value: dict = {}
    for key, value in table.items():
        by_value.setdefault(value, []).append(sql_literal(key))
    branches = " ".join(f"WHEN {column} IN ({', '.join(keys)}) THEN {sql_literal(value)}"
                        for value, keys in by_value.items())
    return F.expr(f"CASE {branches} END")


def inr(c: Column) -> Column:
    """Rupee amount in crore / lakh notation."""
    size = F.abs(c)
    return (
        F.when(size >= 1e7, F.format_string("₹%.2fCr", rounded(c / 1e7, 2)))
        .when(size >= 1e5, F.format_string("₹%.2fL", rounded(c / 1e5, 2)))
        .when(c.isNotNull(), F.concat(F.lit("₹"), F.format_number(rounded(c, 0), 0)))
    )
