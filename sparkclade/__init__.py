"""Phylogenetic and latent-tree inference, and training-data operators, on Spark DataFrames."""

from __future__ import annotations

from pathlib import Path


def attach(spark) -> None:
    """Lets Python workers that share this folder import the package, wherever they start.

    On a cluster, install the package or submit it with --py-files instead."""
    root = str(Path(__file__).resolve().parent.parent)
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in path.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = ":".join(filter(None, [root, path]))
