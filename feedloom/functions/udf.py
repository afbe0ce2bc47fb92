"""Pandas UDFs that are made when they are first called, as their types need a session."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F


def pandas_function(schema: str):
    """Makes a function of Series one of Columns."""

    def decorate(f):
        made = {}

        @wraps(f)
        def call(*columns):
            if "udf" not in made:
                made["udf"] = F.pandas_udf(f, schema)
            return made["udf"](*columns)

        return call

    return decorate
