"""What the operators need of a session: a shared folder, and this package on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..checkpoints import cut, fresh_path, shared_dir, written  # noqa: F401
from ..checkpoints import ship as _ship

BATCH_ROWS = 2000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once a session; they need no copy of the repository.

    Arrow batches are kept to ``BATCH_ROWS`` texts, unless the session asks for
    fewer: ten thousand long texts at a time would be held twice, by JVM and worker.
    """
    if int(spark.conf.get(_ROWS)) > BATCH_ROWS or int(spark.conf.get(_ROWS)) <= 0:
        spark.conf.set(_ROWS, str(BATCH_ROWS))
    _ship(spark)


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table doesn't have, in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name
