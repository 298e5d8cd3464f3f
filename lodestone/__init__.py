"""Corpus retrieval, rule and evaluation engine expressed as Spark DataFrames."""

from __future__ import annotations

import os


def on_workers(spark) -> None:
    """Let Python workers import this package from where the driver has it.

    Enough where that path exists on every machine; elsewhere ship the package with --py-files.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
