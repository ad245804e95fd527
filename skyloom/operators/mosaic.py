"""Mosaics and effective primary beams: partial sums a task, then one row a pixel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def effective_beam(pb: DataFrame, kind: str = "mean") -> DataFrame:
    """Mean or root of the summed squares over beams, scaled to a peak of 1."""
    p = F.col("value")
    value = {"mean": F.avg(p), "rss": F.sqrt(F.sum(p * p))}[kind]
    t = pb.groupBy("y", "x").agg(value.alias("value"))
    return t.crossJoin(F.broadcast(t.agg(F.max("value").alias("peak")))).select("y", "x", (F.col("value") / F.col("peak")).alias("value"))


def linear(tiles: DataFrame, pb: DataFrame, least: float = 0.0) -> DataFrame:
    """Σ pb² image / Σ pb² and sqrt(Σ pb²) over beams; 0 where there is no weight."""
    p = pb.select("beam", "y", "x", F.col("value").alias("pb")).where(F.col("pb") >= least)
    w = F.col("pb") * F.col("pb")
    s = tiles.join(p, ["beam", "y", "x"]).groupBy("y", "x").agg(F.sum(w * F.col("value")).alias("num"), F.sum(w).alias("den"))
    return s.select("y", "x", F.coalesce(F.try_divide("num", "den"), F.lit(0.0)).alias("value"), F.sqrt("den").alias("pb"))


def weighted_polarisations(raw: DataFrame) -> DataFrame:
    """Weighted mean of the two polarisations, summed weight and joined flag of each sample."""
    w = F.col("w0") + F.col("w1")
    out = {c: (F.col("w0") * F.col(f"p0_{c}") + F.col("w1") * F.col(f"p1_{c}")) / w for c in ("re", "im")}
    return raw.withColumns({**out, "weight": w, "flag": F.col("f0") | F.col("f1")})
