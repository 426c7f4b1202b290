"""Report sinks: cost and timing rows are appended to a table and read back.

Every append is a partition named by its run.  An append that is repeated, after a
failure or by a retried job, replaces the partition of its run and leaves each row once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "json")
RUN = "run_id"


def append_report(report: DataFrame, path: str, fmt: str = "parquet", run_id: str | None = None) -> str:
    """Append the rows of one run; the run id, a new one unless given, is returned.

    A run id that is there already is written anew, and the runs beside it stay.
    """
    if fmt not in FORMATS:
        raise ValueError(f"a report is written as one of {', '.join(FORMATS)}")
    if RUN in report.columns:
        raise ValueError(f"{RUN} is the column of the sink")
    run_id = run_id or uuid.uuid4().hex
    rows = report.withColumn(RUN, F.lit(run_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(RUN).format(fmt).save(path)
    return run_id


def read_report(spark: SparkSession, path: str, schema: str | T.StructType, fmt: str = "parquet", runs: bool = False) -> DataFrame:
    """Read all appended rows under the schema they were written with; ``runs`` adds the run id."""
    if fmt not in FORMATS:
        raise ValueError(f"a report is read as one of {', '.join(FORMATS)}")
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    whole = T.StructType([*schema.fields, T.StructField(RUN, T.StringType())])
    found = spark.read.schema(whole).format(fmt).load(path)
    return found if runs else found.drop(RUN)
