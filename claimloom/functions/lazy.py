"""Arrow functions that are made when first used, as making one needs a session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_function(kind: str) -> Callable:
    def wrap(f: Callable) -> Callable[..., Column]:
        def call(*columns) -> Column:
            return F.udf(f, kind, useArrow=True)(*columns)

        call.__name__, call.__doc__ = f.__name__, f.__doc__
        return call

    return wrap
