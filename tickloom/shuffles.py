"""Shuffles whose files go with the query that wrote them."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import SparkSession

#: Whether the files of a query's shuffles go with its end, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Whether rows that are together by some of a join's keys are shuffled again for the join.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


@contextlib.contextmanager
def setting(spark: SparkSession, **values: str) -> Iterator[None]:
    """The session's settings inside, by the names of this module; its own hold again afterwards."""
    names = {globals()[k]: v for k, v in values.items()}
    was = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
