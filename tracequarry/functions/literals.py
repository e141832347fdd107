"""Python literals in place of JSON, as some exporters write them."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tracequarry.functions.text import valid_json


def _literal(texts: pd.Series) -> pd.Series:
    def one(t):
        if t is None or t[:1] not in "[{":
            return None
        try:
            return json.dumps(ast.literal_eval(t), ensure_ascii=False, default=str)
        except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
            return None

    return texts.map(one)


def as_json(c: Column) -> Column:
    """JSON as it is; a Python literal as JSON; null for what is neither. Python sees only texts that are not JSON: the others are null for it."""
    good = valid_json(c)
    return F.coalesce(good, F.pandas_udf(_literal, StringType())(F.when(good.isNull(), c)))
