"""Session settings the library relies on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import barloom


def tune(spark: SparkSession) -> SparkSession:
    """Turn off constraint propagation for the session.

    The optimiser derives extra filters by rewriting every known constraint
    with every alias.  On a feature panel of about a hundred derived columns
    that search is exponential (minutes of planning, gigabytes of expressions)
    and finds nothing useful.  Pushdown of the filters actually written, and
    column pruning, do not depend on it.
    """
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Give the package to the Python workers of the session, once.

    Functions of the package that run in workers are looked up by name there, so
    the workers need it even when the driver was started from another folder.
    """
    sc = spark.sparkContext
    if not getattr(sc, "_barloom_shipped", False):
        root = Path(barloom.__file__).parent
        target = os.path.join(tempfile.mkdtemp(prefix="barloom-package-"), "barloom.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, Path("barloom") / path.relative_to(root))
        sc.addPyFile(target)
        sc._barloom_shipped = True
    return spark
