"""Column functions for notebook cells: number coercion, formatting, ids, tokens, lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# One number grammar for every coercer.  It keeps out forms that Spark's cast
# accepts but a notebook reader would not expect (``1d``, ``NaN``, ``Infinity``).
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
WORD = r"[a-zA-Z][a-zA-Z0-9_\-]+"
TERM = r"[a-zA-Z][a-zA-Z0-9\-]+"


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def nonblank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) != ""


def text(c: Column) -> Column:
    """Cell as text, NULL shown as blank."""
    return F.coalesce(c, F.lit(""))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(c: Column, terms) -> Column:
    return any_of([c.contains(t) for t in terms])


# -- numbers ------------------------------------------------------------------

def _number(c: Column) -> Column:
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def _first_token(c: Column) -> Column:
    return F.regexp_extract(c, r"(\S+)", 1)


def num_strict(c: Column) -> Column:
    """The whole cell is a number."""
    return _number(F.trim(c))


def num_token(c: Column) -> Column:
    """First blank-separated token is a number; commas are not removed."""
    return _number(_first_token(c))


def num_first_token(c: Column) -> Column:
    """First token after thousands commas are removed."""
    return _number(_first_token(F.replace(c, F.lit(","), F.lit(""))))


def num_fraction(c: Column) -> Column:
    """A fraction in (0, 1]: plain number or ``NN%``."""
    t = F.trim(F.replace(c, F.lit(","), F.lit("")))
    percent = _number(F.trim(F.regexp_replace(t, "%$", ""))) / 100
    x = F.when(t.endswith("%"), percent).otherwise(num_first_token(t))
    return F.when((x > 0) & (x <= 1), x)


def exact_sum(c: Column) -> Column:
    """Sum of doubles that does not depend on row order.

    Adds as DECIMAL.  A group with a value too large for it (beyond 1e15) has no sum (NULL).
    """
    d = c.try_cast("decimal(28,12)")
    return F.when(F.count(d) == F.count(c), F.sum(d).cast("double"))


def round6(c: Column) -> Column:
    """Six decimals: the double nearest to a whole number of millionths, halves of the scaled double to even."""
    return F.rint(c * 1e6) / 1e6


# -- formatting ---------------------------------------------------------------

def fmt6(c: Column) -> Column:
    """At most six decimals, trailing zeros dropped (``2.5``, ``3``)."""
    s = F.format_string("%.6f", round6(c))
    return F.when(c.isNotNull(), F.regexp_replace(s, r"\.?0+$", ""))


def fmt6g(c: Column) -> Column:
    """Six significant digits, trailing zeros dropped."""
    s = F.format_string("%.6g", c)
    t = F.when(s.contains("."), F.regexp_replace(s, r"\.?0+(e|$)", "$1")).otherwise(s)
    return F.when(c.isNotNull(), t)


def short_text(c: Column, limit: int) -> Column:
    """Blanks collapsed; longer text is cut with an ellipsis (display field of the report)."""
    t = F.trim(F.regexp_replace(text(c), r"\s+", " "))
    cut = F.concat(F.rtrim(F.substring(t, 1, max(limit - 3, 0))), F.lit("..."))
    return F.when(F.length(t) <= limit, t).otherwise(cut)


# -- ids ----------------------------------------------------------------------

def slugify(c: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(c)), r"[^a-zA-Z0-9_.\-/]+", "-")
    s = F.regexp_replace(s, r"^-+|-+$", "")
    return F.when(s == "", F.lit("experiment")).otherwise(s)


def compact_token(c: Column, width: int, default: str) -> Column:
    s = F.substring(F.regexp_replace(text(c), r"[^A-Za-z0-9]+", ""), 1, width)
    return F.when(s == "", F.lit(default)).otherwise(s)


def evidence_prefix(experiment_id: Column) -> Column:
    return F.concat(F.lit("LIT-"), F.replace(F.upper(slugify(experiment_id)), F.lit("/"), F.lit("-")), F.lit("-"))


def padded(c: Column, width: int) -> Column:
    """Zero-padded number text; longer numbers are kept whole."""
    s = c.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


# -- lists in cells -----------------------------------------------------------

def split_list(c: Column, semicolons: bool = True) -> Column:
    """Trimmed, nonblank items of a comma (and semicolon) separated cell."""
    t = F.replace(text(c), F.lit(";"), F.lit(",")) if semicolons else text(c)
    return F.filter(F.transform(F.split(t, ","), lambda x: F.trim(x)), lambda x: x != "")


def present(items: list[tuple[Column, Column]]) -> Column:
    """Array of the values whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, value) for cond, value in items]))


# -- tokens -------------------------------------------------------------------

def words(c: Column) -> Column:
    """Search tokens: matched first, lower-cased after."""
    return F.transform(F.regexp_extract_all(text(c), F.lit(WORD), F.lit(0)), lambda w: F.lower(w))


def terms(c: Column) -> Column:
    """Query terms: lower-cased first, no underscore inside a term."""
    return F.regexp_extract_all(F.lower(text(c)), F.lit(TERM), F.lit(0))


def relevance_terms(c: Column, stop_words: list[str]) -> Column:
    """Distinct terms longer than two letters without stop words and run ids."""
    return F.filter(
        F.array_distinct(terms(c)),
        lambda t: (F.length(t) > 2) & ~t.isin(stop_words) & ~t.startswith("ep-"),
    )


def key_values(pairs: list[tuple[str, str]], skip_blank: bool = False) -> Column:
    """``name value name value …`` text of a row; ``pairs`` are (name, column name)."""
    if skip_blank:
        parts = [f"if(trim(`{c}`) <> '', '{n} ' || `{c}`, null)" for n, c in pairs]
    else:
        parts = [f"'{n} ' || coalesce(`{c}`, '')" for n, c in pairs]
    return F.expr("concat_ws(' ', " + ", ".join(parts) + ")")
