"""Relaxed temporal motif mining on Spark DataFrames."""

from __future__ import annotations

import os

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _with_root(path: str) -> str:
    return path if _ROOT in path.split(os.pathsep) else os.pathsep.join(x for x in (_ROOT, path) if x)


# sessions that start later: their workers look here, wherever the driver runs
os.environ["PYTHONPATH"] = _with_root(os.environ.get("PYTHONPATH", ""))


def importable(spark) -> None:
    """Let the Python workers of a running session import this package from where the driver did.

    On a cluster whose machines do not share that folder, pass the package with --py-files.
    """
    environment = spark.sparkContext.environment
    environment["PYTHONPATH"] = _with_root(environment.get("PYTHONPATH", ""))
