"""Join operators on their own, with the physical strategy as a hint where a name asks for one."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame


def hash_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join by a shuffled hash table."""
    return left.join(right.hint("shuffle_hash"), list(on), how)


def merge_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join by sorting both sides."""
    return left.join(right.hint("merge"), list(on), how)


def theta_join(left: DataFrame, right: DataFrame, condition: Callable[[DataFrame, DataFrame], Column], on: Sequence[str] = ()) -> DataFrame:
    """Join by any condition. Columns in ``on`` are joined by equality first, so that only their groups are compared."""
    l, r = left.alias("l"), right.alias("r")
    test = condition(l, r)
    for c in on:
        test = test & (l[c] == r[c])
    return l.join(r, test)


def semi_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows with a partner: how a magic relation restricts a rule."""
    return left.join(right, list(on), "left_semi")


def anti_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows without a partner: negation as failure, MINUS."""
    return left.join(right, list(on), "left_anti")


def project(df: DataFrame, names: Sequence[str], inverse: bool = False) -> DataFrame:
    return df.drop(*names) if inverse else df.select(*names)
