"""Session settings that suit tables of long texts."""

from __future__ import annotations

from pyspark.sql import SparkSession

_KEY, _DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def for_long_texts(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in each batch that goes to Python and back, unless the session says how many."""
    if spark.conf.get(_KEY, _DEFAULT) == _DEFAULT:
        spark.conf.set(_KEY, str(rows))
