"""Scores of texts, answers and vectors as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import answer_tokens, as_col, normalize_answer


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Shared part of two token arrays, as sets; 0 if both are empty."""
    u = F.size(F.array_union(as_col(a), as_col(b)))
    return F.when(u > 0, F.size(F.array_intersect(as_col(a), as_col(b))) / u).otherwise(F.lit(0.0))


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product of two arrays, in double precision."""
    return F.aggregate(F.zip_with(as_col(a), as_col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def overlap(p: Column, g: Column) -> Column:
    """Tokens two arrays share, with their multiplicity."""
    count = lambda arr, t: F.size(F.filter(arr, lambda x: x == t))
    return F.aggregate(F.array_distinct(p), F.lit(0), lambda s, t: s + F.least(count(p, t), count(g, t)))


def token_f1(pred: str | Column, gold: str | Column, both_empty: float = 0.0) -> Column:
    """F1 of the tokens of two answers; ``both_empty`` if neither has any."""
    p, g = answer_tokens(pred), answer_tokens(gold)
    common = overlap(p, g)
    f1 = F.when(common == 0, F.lit(0.0)).otherwise(2.0 * (common / F.size(p)) * (common / F.size(g)) / (common / F.size(p) + common / F.size(g)))
    return F.when((F.size(p) == 0) & (F.size(g) == 0), F.lit(both_empty)).otherwise(f1)


def best_f1(pred: str | Column, golds: str | Column, both_empty: float = 0.0) -> Column:
    """The best token_f1 over several gold answers; 0 if there are none."""
    return F.coalesce(F.array_max(F.transform(as_col(golds), lambda g: token_f1(pred, g, both_empty))), F.lit(0.0))


def exact_match(pred: str | Column, golds: str | Column) -> Column:
    return F.coalesce(F.exists(as_col(golds), lambda g: normalize_answer(g) == normalize_answer(pred)), F.lit(False)).cast("double")


def contained_match(pred: str | Column, golds: str | Column) -> Column:
    """1 if some gold answer that is not empty stands in the prediction, after normalising."""
    return F.coalesce(F.exists(as_col(golds), lambda g: (normalize_answer(g) != "") & F.contains(normalize_answer(pred), normalize_answer(g))), F.lit(False)).cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b with b floored at 1."""
    return a / F.greatest(b, F.lit(1))
