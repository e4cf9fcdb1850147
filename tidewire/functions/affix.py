"""Affix globs: a glob matches a name that starts or ends with it; no globs match every name."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def affix_match(name: Column, globs: Column) -> Column:
    return (F.size(globs) == 0) | F.exists(globs, lambda g: name.startswith(g) | name.endswith(g))


def affix_match_literal(name: Column, globs: Sequence[str]) -> Column:
    """The same for globs known when the query is built: plain predicates a scan can push down."""
    if not globs or "" in globs:
        return F.lit(True)
    tests = [test for g in dict.fromkeys(globs) for test in (name.startswith(g), name.endswith(g))]
    return reduce(lambda a, b: a | b, tests)


def any_affix_match(names: Column, globs: Column) -> Column:
    """Some name matches some glob; an empty list on either side passes."""
    return (F.size(names) == 0) | (F.size(globs) == 0) | F.exists(names, lambda n: affix_match(n, globs))


def affixes(name: Column) -> Column:
    """Every prefix and suffix of ``name`` with the empty string: the join keys of an affix join."""
    length = F.length(name)
    starts = F.transform(F.sequence(F.lit(0), length), lambda n: F.substring(name, F.lit(1), n))
    ends = F.transform(F.sequence(F.lit(0), length), lambda n: F.substring(name, length - n + 1, n))
    return F.array_distinct(F.concat(starts, ends))


def glob_keys(globs: Column) -> Column:
    """Globs as join keys for :func:`affixes`; "no globs" is the glob that matches everything."""
    return F.when(F.coalesce(F.size(globs), F.lit(0)) <= 0, F.array(F.lit(""))).otherwise(F.array_distinct(globs))
