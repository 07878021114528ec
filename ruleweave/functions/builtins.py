"""Builtin predicates of rules as Column expressions.

``log:`` compares terms, ``math:`` numeric values, ``string:`` lexical forms. A
value of the wrong type makes the test false, never an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..terms import LOG, MATH, STRING, lexical, numeric

Test = Callable[[Column, Column], Column]


def _log(f: Test) -> Test:
    return lambda a, b: f(a.cast("string"), b.cast("string"))


def _math(f: Test) -> Test:
    return lambda a, b: f(numeric(a), numeric(b))


def _string(f: Test) -> Test:
    return lambda a, b: f(lexical(a), lexical(b))


BUILTINS: dict[str, Test] = {
    f"<{LOG}equalTo>": _log(lambda a, b: a == b),
    f"<{LOG}notEqualTo>": _log(lambda a, b: a != b),
    f"<{MATH}equalTo>": _math(lambda a, b: a == b),
    f"<{MATH}notEqualTo>": _math(lambda a, b: a != b),
    f"<{MATH}greaterThan>": _math(lambda a, b: a > b),
    f"<{MATH}lessThan>": _math(lambda a, b: a < b),
    f"<{MATH}notLessThan>": _math(lambda a, b: a >= b),
    f"<{MATH}notGreaterThan>": _math(lambda a, b: a <= b),
    f"<{STRING}greaterThan>": _string(lambda a, b: a > b),
    f"<{STRING}lessThan>": _string(lambda a, b: a < b),
    f"<{STRING}greaterThanOrEqualTo>": _string(lambda a, b: a >= b),
    f"<{STRING}lessThanOrEqualTo>": _string(lambda a, b: a <= b),
    f"<{STRING}notGreaterThan>": _string(lambda a, b: a <= b),
    f"<{STRING}notLessThan>": _string(lambda a, b: a >= b),
    f"<{STRING}contains>": _string(lambda a, b: a.contains(b)),
    f"<{STRING}containsIgnoringCase>": _string(lambda a, b: F.lower(a).contains(F.lower(b))),
    f"<{STRING}equalIgnoringCase>": _string(lambda a, b: F.lower(a) == F.lower(b)),
    f"<{STRING}notEqualIgnoringCase>": _string(lambda a, b: F.lower(a) != F.lower(b)),
    f"<{STRING}startsWith>": _string(lambda a, b: a.startswith(b)),
    f"<{STRING}endsWith>": _string(lambda a, b: a.endswith(b)),
    f"<{STRING}matches>": _string(lambda a, b: F.regexp_like(a, b)),
    f"<{STRING}notMatches>": _string(lambda a, b: ~F.regexp_like(a, b)),
}
#: Ranges hold for resources, not for literals.
BUILTINS["term:isResource"] = BUILTINS["<term:isResource>"] = lambda a, _: ~F.startswith(a.cast("string"), F.lit('"'))
#: Short names, e.g. ``math:lessThan``.
BUILTINS |= {k[1:-1].replace(LOG, "log:").replace(MATH, "math:").replace(STRING, "string:"): f for k, f in list(BUILTINS.items())}
