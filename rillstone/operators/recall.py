"""Recall of references to deleted objects, with a Bloom filter of the deleted at the scan of the references.

A run deletes few objects, references are many. Spark's runtime filter sums the deleted ids up in a Bloom filter and tests
references against it as they are read, so that almost only those that are recalled are shuffled. It adds the filter where
the deleted side has a selective predicate and the references' scan is large enough; here any size is.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.operators.match import referencing
from rillstone.session import stored


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings (dots as __) for what is planned inside."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def bloom_filters(spark: SparkSession, expected: int = 1_000_000):
    """Runtime filters on, at scans of any size, sized for so many deleted objects."""
    name = "spark__sql__optimizer__runtime__bloomFilter__"
    return settings(spark, **{f"{name}enabled": "true", f"{name}applicationSideScanSizeThreshold": "0", f"{name}expectedNumItems": str(expected)})


def recalled(changes: DataFrame, values: DataFrame, target_values: DataFrame, at: str, expected: int = 1_000_000) -> DataFrame:
    """owner, attr, ref, held of references to objects that a run deletes; a table, as both exports and reports read it.

    changes: id, change. values, target_values: owner, attr, ref.
    """
    with bloom_filters(changes.sparkSession, expected):
        return stored(referencing(changes.filter("change = 'delete'").select("id"), values, target_values), at, "recalled")
