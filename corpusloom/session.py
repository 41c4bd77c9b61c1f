"""Session factory for local runs and tests; a cluster brings its own session."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(cores: int | None = None, app: str = "corpusloom", **conf: str) -> SparkSession:
    """A local session: AQE on, UTC, and a checkpoint folder only where none is set."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not shared_folder(spark):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="corpusloom-"))
    return spark


def shared_folder(spark: SparkSession) -> str | None:
    """The folder all executors share, as the session names it."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():
        with tempfile.NamedTemporaryFile(prefix="corpusloom-", suffix=".zip", delete=False) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(f.name)
        # The driver serves the file to executors as long as it runs.
        atexit.register(lambda: Path(f.name).unlink(missing_ok=True))
    _shipped.add(app)
