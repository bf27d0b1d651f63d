"""Code for executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(df: DataFrame) -> DataFrame:
    """Let executors import this package when their Python path does not have it, and bound Arrow batches by bytes.

    Rows alone bound nothing where texts are long. A session that sets the bound itself keeps its own.
    """
    if BATCH_BYTES not in df.sparkSession.conf.getAll:
        df.sparkSession.conf.set(BATCH_BYTES, str(4 << 20))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        sc = df.sparkSession.sparkContext
        name = f"graphquarry-{os.getpid()}.zip"
        if not any(x.endswith(name) for x in sc._python_includes):
            at = os.path.join(tempfile.mkdtemp(), name)
            with zipfile.ZipFile(at, "w") as z:
                for d, _, names in os.walk(os.path.join(root, "graphquarry")):
                    for x in names:
                        if x.endswith(".py"):
                            z.write(os.path.join(d, x), os.path.relpath(os.path.join(d, x), root))
            sc.addPyFile(at)
    return df
