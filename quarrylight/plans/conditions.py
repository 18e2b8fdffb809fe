"""The rules' own predicate language: a map from field to matcher, all of which must hold.

Compiled predicates are two-valued: no field value is null, so `not` and `not_in` hold for missing fields.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.fields import field_ref
from ..functions.numbers import number_of, parse_number
from ..functions.regexes import re2_to_java

#: Operators of a matcher (fixed names of the rule format).
OPERATORS = ("equals", "not", "in", "not_in", "contains", "prefix", "regex", "gte", "lte", "exists")


def scalar_text(value) -> str:
    """A YAML scalar as its text."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


def _list_test(value: Column, items: list) -> Column:
    return value.isin([scalar_text(i) for i in items]) if items else F.lit(False)


def compile_matcher(field: str, matcher) -> Column:
    """One field's test; a plain value means equals."""
    value, exists = field_ref(field)
    if not isinstance(matcher, dict):
        if isinstance(matcher, list):
            raise ValueError(f"{field}: a list needs `in` or `not_in`")
        return value == scalar_text(matcher)
    unknown = set(matcher) - set(OPERATORS)
    if unknown:
        raise ValueError(f"{field}: unknown operator {sorted(unknown)[0]}")
    tests = [F.lit(True)]
    for op, want in matcher.items():
        if want is None:
            continue
        if op == "exists":
            if not isinstance(want, bool):
                raise ValueError(f"{field}: exists must be true or false")
            tests.append(exists == F.lit(want))
        elif op == "equals":
            tests.append(value == scalar_text(want))
        elif op == "not":
            tests.append(value != scalar_text(want))
        elif op in ("in", "not_in"):
            if not isinstance(want, list):
                raise ValueError(f"{field}: {op} must be a list")
            found = _list_test(value, want)
            tests.append(found if op == "in" else ~found)
        elif op == "contains" and want != "":
            tests.append(F.contains(value, F.lit(scalar_text(want))))
        elif op == "prefix" and want != "":
            tests.append(F.startswith(value, F.lit(scalar_text(want))))
        elif op == "regex" and want != "":
            tests.append(value.rlike(re2_to_java(scalar_text(want))))
        elif op in ("gte", "lte"):
            number, bound = number_of(value), parse_number(want)
            # a NaN field passes both bounds: neither "below" nor "above" is true of it. To Spark it is above all
            ok = number >= bound if op == "gte" else F.nanvl(number, F.lit(float("-inf"))) <= bound
            tests.append(F.coalesce(ok, F.lit(False)))
    return reduce(and_, tests)


def compile_condition(condition: dict | None) -> Column:
    """All matchers hold; an empty condition is true."""
    return reduce(and_, [compile_matcher(str(k), v) for k, v in (condition or {}).items()], F.lit(True))
