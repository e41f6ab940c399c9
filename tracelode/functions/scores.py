"""The thirteen contrast scores as Column builders.

A score takes the probabilities f and o that a failing and a passing run contain a location or pattern, and the
priors pf and po.  Division follows IEEE (0/0 is NaN, x/0 infinite) although ANSI mode raises on it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Score = Callable[[Column, Column, Column, Column], Column]


def ieee_div(a: Column, b: Column) -> Column:
    zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(F.when(F.isnan(a), a).otherwise(zero))


def _excess(f: Column, o: Column, pf: Column, po: Column) -> Column:
    return ieee_div(f, f + o) - ieee_div(pf, pf + po)


def _plogp(p: Column) -> Column:
    return F.when(p > 0, p * F.log2(F.when(p > 0, p))).otherwise(F.when(F.isnan(p), p).otherwise(F.lit(0.0)))


def relative_precision(f, o, pf, po):
    return _excess(f, o, pf, po)


def relative_f1(f, o, pf, po):
    return 2 * ieee_div(f + o, pf + f + o) * _excess(f, o, pf, po)


def relative_jaccard(f, o, pf, po):
    return ieee_div(f, pf + o) - ieee_div(pf, pf + po)


def relative_ochiai(f, o, pf, po):
    return F.sqrt(ieee_div(f + o, pf)) * _excess(f, o, pf, po)


def precision(f, o, pf, po):
    return ieee_div(f, f + o)


def f1(f, o, pf, po):
    return 2 * ieee_div(f + o, pf + f + o) * ieee_div(f, f + o)


def jaccard(f, o, pf, po):
    return ieee_div(f, pf + o)


def ochiai_squared(f, o, pf, po):
    return ieee_div(f, pf) * ieee_div(f, f + o)


def ochiai(f, o, pf, po):
    return F.sqrt(ochiai_squared(f, o, pf, po))


def contrast(f, o, pf, po):
    return f - o


def expr(f, o, pf, po):
    return ieee_div(f - o, pf + o)


def associational_risk(f, o, pf, po):
    return ieee_div(f - pf * f - pf * o, (f + o + 0.00001) - (f + o) * (f + o))


def information_gain(f, o, pf, po):
    return _plogp(ieee_div(f, f + o)) + _plogp(ieee_div(o, f + o)) - (_plogp(pf) + _plogp(po))


SCORES: dict[str, Score] = {
    s.__name__: s
    for s in (relative_precision, relative_f1, relative_jaccard, relative_ochiai, precision, f1, jaccard, ochiai_squared, ochiai, contrast, expr, associational_risk, information_gain)
}

#: Short names of the scores.
ABBREVIATIONS = {
    "rp": "relative_precision", "rf1": "relative_f1", "rj": "relative_jaccard", "ro": "relative_ochiai", "p": "precision", "precision": "precision", "f1": "f1",
    "j": "jaccard", "jaccard": "jaccard", "o2": "ochiai_squared", "o": "ochiai", "och": "ochiai", "ochiai": "ochiai", "c": "contrast", "expr": "expr",
    "ar": "associational_risk", "ig": "information_gain",
}


def score(name: str | Score) -> Score:
    """A score by its name or short name; a function of the four columns is a score itself."""
    if callable(name):
        return name
    return SCORES[name] if name in SCORES else SCORES[ABBREVIATIONS[name]]


def priority(s: Column) -> Column:
    """The score as an integer priority, truncated towards zero."""
    return (s * 100000).cast("bigint")


def upper_bound(name: str | Score, pf: Column, po: Column, f: Column, o: Column, least_f: Column, least_o: Column) -> Column:
    """The most that an extension of a pattern may score: of the least failing support with this o, or of this f with
    the least o.  A NaN loses to a number."""
    a, b = score(name)(least_f, o, pf, po), score(name)(f, least_o, pf, po)
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b))
