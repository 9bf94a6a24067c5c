"""What a session needs before queries run."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors, once per application: their Python need not find it where the driver does.

    Spark's own file service sends the archive; the driver only needs a place to hand it over from.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(here)):
            for name in sorted(n for n in names if n.endswith((".py", ".json"))):
                path = os.path.join(folder, name)
                z.write(path, os.path.relpath(path, os.path.dirname(here)))
    archive = os.path.join(tempfile.mkdtemp(prefix="crumbline-"), "crumbline.zip")
    with open(archive, "wb") as f:
        f.write(content.getvalue())
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
