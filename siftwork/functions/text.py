"""Column-level text functions (all native Spark expressions, codegen friendly).

Each function takes and returns a ``Column``; nothing here triggers an action.
Regexes are written so that Java (Spark) and RE2 (the SQL oracle) agree on
ASCII input; operators that compare values run on ``clean_text``.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip()/split() whitespace, spelled out (RE2's \s lacks \x0B).
WS = r"[ \t\n\r\f\x0B]"
WS_RUN = r"[ \t\n\r\f\x0B]+"


def col(c: Column | str) -> Column:
    """The column as text; null is the empty text, everywhere in this module and in the operators built on it."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def once(df, name: str, value: Column):
    """``df`` with a column that is made once per row: as the output of a generator it is not copied into each
    expression that uses it, as Catalyst does with plain projections, and lambdas don't make it anew."""
    return df.withColumn(name, F.explode(F.array(value)))


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` made once: in ``fn`` it is a lambda's variable, not a copy of the expression at each use."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def starts_of(values: str) -> Column:
    """Places (from 0) in the sorted array column ``values`` at which another value begins."""
    v = F.col(values)
    starts = F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: (i == 0) | (F.get(v, i) != F.get(v, i - 1)))
    return F.when(F.size(v) > 0, starts).otherwise(F.array().cast("array<int>"))


def has_any(c: Column, pattern: str) -> Column:
    """Whether ``pattern`` is found in the text; one that only lists plain texts, ``(a|b)``, is looked up as these."""
    plain = re.fullmatch(r"\(([a-z]+(?:[ |][a-z]+)*)\)", pattern)
    if not plain:
        return c.rlike(pattern)
    words = plain[1].split("|")
    least = [w for w in words if not any(v != w and v in w for v in words)]  # what holds a longer one holds it too
    return reduce(lambda a, b: a | b, [c.contains(w) for w in dict.fromkeys(least)])


def py_strip(c: Column | str) -> Column:
    """str.strip(): drop leading and trailing whitespace."""
    return F.regexp_replace(col(c), rf"^{WS_RUN}|{WS_RUN}$", "")


def clean_text(c: Column | str) -> Column:
    """Normalise line ends, squeeze blank lines and blank runs, blank out non-printables, strip."""
    t = F.regexp_replace(col(c), r"\r\n|\r", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"[ \t]{2,}", " ")
    t = F.regexp_replace(t, r"[^\x20-\x7E\n]", " ")
    return F.regexp_replace(t, r"^[ \n]+|[ \n]+$", "")


def replaced_chars(c: Column | str) -> Column:
    """Characters that ``clean_text`` blanks out (counted after the first three steps)."""
    t = F.regexp_replace(col(c), r"\r\n|\r", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"[ \t]{2,}", " ")
    return F.regexp_count(t, F.lit(r"[^\x20-\x7E\n]"))


def word_count(c: Column | str) -> Column:
    """len(text.split()): whitespace-separated tokens (0 for empty text)."""
    return F.regexp_count(col(c), F.lit(r"[^ \t\n\r\f\x0B]+"))


def token_normal_form(c: Column | str) -> Column:
    """Lower-case; every char outside [a-z0-9 whitespace] and every newline is its own token;
    blank runs collapse to one space.  A phrase occurs iff ' '+its form+' ' is contained in
    ' '+this form+' '."""
    t = F.lower(col(c))
    t = F.regexp_replace(t, r"([^a-z0-9 \t\n\r\f\x0B])", " $1 ")
    t = F.regexp_replace(t, r"\n", " \n ")
    t = F.regexp_replace(t, r"[ \t\r\f\x0B]+", " ")
    return F.regexp_replace(t, r"^ +| +$", "")


def _gram_fn(toks: Column, n: int):
    return lambda i: F.array_join(F.slice(toks, i, n), " ")


def filled(template: str, **values: Column) -> Column:
    """A fixed sentence with its ``{name}`` places filled by columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])


def quant_count(c: Column | str) -> Column:
    """Number of r'\\b\\d+[%+]?\\b' hits, which equals the number of r'\\b\\d+\\b' hits."""
    return F.regexp_count(col(c), F.lit(r"\b\d+\b"))


def python_title(c: Column | str) -> Column:
    """str.title(): first letter of every letter run upper, the rest lower."""
    marked = F.regexp_replace(F.lower(col(c)), r"([^A-Za-z])(?=[A-Za-z])", "$1\u0001 ")
    return F.regexp_replace(F.initcap(marked), "\u0001 ", "")


def first_word_lower(c: Column | str) -> Column:
    """First whitespace token, lower-cased, trailing '.,;' removed ('' if none)."""
    first = F.regexp_extract(col(c), r"^[ \t\n\r\f\x0B]*([^ \t\n\r\f\x0B]+)", 1)
    return F.regexp_replace(F.lower(first), r"[.,;]+$", "")
