"""Message templates, and conditions joined."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDER = re.compile(r"\${1,3}([A-Za-z_][A-Za-z0-9_]*)")


def template(text: str, bound: dict[str, str]) -> str:
    """``text`` with $NAME and $$$NAME replaced by captured text; what isn't bound stays as it's written."""
    return PLACEHOLDER.sub(lambda m: bound.get(m[1], m[0]), text)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
