"""What a session needs so that Python workers can import the library, and the library's loggers.

Loggers are children of `siltstone`: rules, lines, formats, records, events, outcomes, streams. They never quote a line.
"""

from __future__ import annotations

import logging
import os
from pathlib import Path

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


LOGGERS = ("rules", "lines", "formats", "records", "events", "outcomes", "streams")


def logger(part: str) -> logging.Logger:
    if part not in LOGGERS:
        raise ValueError(f"no logger {part!r}; there are {', '.join(LOGGERS)}")
    return logging.getLogger(f"siltstone.{part}")


def init_logging(level: str = "WARNING") -> None:
    """Sends the library's messages of `level` and above to standard error."""
    root = logging.getLogger("siltstone")
    root.setLevel(level)
    if not root.handlers:
        root.addHandler(logging.StreamHandler())
