"""Session helpers: a local session for scripts, and shipping this package to executors that can't import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tracewright")
    defaults = {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}
    session = builder.config(map=defaults | conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return ship(session)


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors, once a session, unless they find it by PYTHONPATH or the working folder."""
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if str(ROOT) not in known and spark.conf.get("spark.tracewright.shipped", None) is None:
        path = Path(tempfile.mkdtemp(prefix="tracewright-")) / "tracewright.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted((ROOT / "tracewright").rglob("*.py")):
                z.write(p, p.relative_to(ROOT))
        spark.sparkContext.addPyFile(str(path))
        spark.conf.set("spark.tracewright.shipped", "true")
    return spark
