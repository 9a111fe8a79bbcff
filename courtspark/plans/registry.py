"""All registered queries."""

from __future__ import annotations

from functools import wraps

from courtspark.plans import data, detect, geometry, identity, io, match, stream
from courtspark.session import ship_package

MODULES = [geometry, match, detect, data, identity, stream, io]


def _with_package(fn):
    @wraps(fn)
    def run(spark, sf_dir):
        ship_package(spark)
        return fn(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _with_package(fn) for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
