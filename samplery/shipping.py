"""Makes this package importable in Python workers, wherever the driver was started."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the application once, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="samplery-"), "samplery.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, str(f.relative_to(top.parent)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def map_arrow(df: DataFrame, function, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with a function of this package; columns may have names with dots and back-ticks."""
    ship(df.sparkSession)
    names = df.columns

    def run(batches):
        return function(pa.RecordBatch.from_arrays(b.columns, names) for b in batches)

    return df.toDF(*[f"c{k}" for k in range(len(names))]).mapInArrow(run, schema)
