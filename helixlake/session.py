"""Session settings, and the package's way to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def build(app: str = "helixlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that results rely on: ANSI on, UTC, adaptive execution."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true",
                "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that functions run there find it without an installation."""
    sc = spark.sparkContext
    if getattr(sc, "_helixlake_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="helixlake-")) / "helixlake.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(ROOT.glob("helixlake/**/*.py")) + sorted(ROOT.glob("corpus_pipeline.py")):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(str(path))
    sc._helixlake_shipped = True
