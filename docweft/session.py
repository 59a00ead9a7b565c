"""Session settings.

``local_session`` is for tests, benches and the command line.  On a cluster the
caller owns the session; nothing in the library changes its settings except
``durable.ensure_checkpoint_dir``, which only fills in a missing checkpoint
folder on a local master.
"""

from __future__ import annotations

import os
import sys

from pyspark import cloudpickle
from pyspark.sql import SparkSession

#: What any session should have; a cluster's own values win where it sets them.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", app: str = "docweft", memory: str = "8g", shuffle: int = 8) -> SparkSession:
    """A local session with ``SETTINGS``; ``shuffle`` is the number of shuffle partitions."""
    os.environ.setdefault("PYTHONHASHSEED", "0")
    b = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.driver.memory", memory)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle))
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ships(name: str) -> None:
    """Send the functions of module ``name`` to executors by value, so that they need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


class Kept:
    """A function of hashable arguments that keeps its results, up to ``most``; travels to executors empty."""

    def __init__(self, f, most: int = 1 << 16):
        self.f, self.most, self.seen = f, most, {}

    def __call__(self, *x):
        got = self.seen.get(x)
        if got is None:
            if len(self.seen) >= self.most:
                self.seen.clear()
            got = self.seen[x] = self.f(*x)
        return got

    def __reduce__(self):
        return Kept, (self.f, self.most)


ships(__name__)
