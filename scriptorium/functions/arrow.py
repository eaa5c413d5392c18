"""Arrow functions that are made when they are called, so that workers can import their modules without a session."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F


def arrow(kind: str):
    def of(f):
        @functools.wraps(f)
        def call(*columns):
            return F.pandas_udf(f, kind)(*columns)

        return call

    return of
