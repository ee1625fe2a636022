"""Incremental joint state counts: counts are additive over sites, so a stream of site columns adds up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def conf_stream(columns: DataFrame) -> DataFrame:
    """Running conf(i, j, a, b, cnt) of a stream of site columns (site, states map<taxon, state>)."""
    cells = F.expr("flatten(transform(map_entries(states), x -> transform(filter(map_entries(states), y -> x.key < y.key), y -> struct(x.key as i, y.key as j, x.value as a, y.value as b))))")
    return columns.select(F.explode(cells).alias("c")).groupBy("c.i", "c.j", "c.a", "c.b").agg(F.count("*").alias("cnt"))
