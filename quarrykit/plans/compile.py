"""From a parsed query to one boolean Column over (name, path, is_dir, size, count, is_dup).

Built-in functions only, so that Catalyst can push what the source understands. Values are two-valued: a test of
something unknown is false, and its negation true.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrykit.functions.text import ascii_fold, contains_fold, extension, fold_text, glob_match
from quarrykit.plans.query import Compare, Query, Term


def pattern(c: Column, text: str) -> Column:
    return glob_match(c, text) if "*" in text or "?" in text else contains_fold(c, text)


def compared(c: Column, by: Compare) -> Column:
    value = F.lit(by.value)
    if isinstance(by.value, float):
        if math.isnan(by.value):
            return F.lit(False)  # Spark would call NaN equal to itself and larger than all
        if by.op == "=":
            return F.abs(c - value) < F.lit(2.220446049250313e-16)
    return {">=": c >= value, "<=": c <= value, ">": c > value, "<": c < value, "=": c == value}[by.op]


def term_column(term: Term) -> Column:
    match term.kind:
        case "name" | "path":
            return pattern(F.col(term.kind), term.value)
        case "ext":
            return ascii_fold(extension(F.col("name"))).isin([fold_text(e) for e in term.value])
        case "size":
            # the size of a folder is unknown and counts as 0; kept apart so that the source gets the plain test
            known = compared(F.col("size"), term.value)
            return known | F.col("size").isNull() if term.value.holds(0) else known
        case "runcount":
            return compared(F.coalesce(F.col("count"), F.lit(0)).cast("double"), term.value)
        case "dup":
            return F.col("is_dup")
        case "isdir":
            return F.col("is_dir") if term.value else ~F.col("is_dir")
    raise ValueError(term.kind)


def predicate(query: Query) -> Column:
    parts = [F.coalesce(term_column(c.term), F.lit(False)) for c in query.clauses]
    parts = [~p if c.negated else p for p, c in zip(parts, query.clauses)]
    return reduce(and_, parts, F.lit(True))
