"""Streaming queries (q79-q82): run over what there is, given as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import fixtures
from ..storage import Scratch
from ..streaming import slabs
from .registry import ORACLES, QUERIES, query


def _folder(spark, label: str) -> str:
    return f"{Scratch(spark, 'streams').path}/{label}"


def _plain(t):
    """Window starts as they were stored, without a zone."""
    return t.withColumn("start", F.col("start").cast("timestamp_ntz"))


def slabs_across_blocks(spark, sf_dir):
    """Planes of each block stream in, a file a batch; a slab of two channels comes out once all seven blocks are there."""
    planes = fixtures.view(spark, sf_dir, "fx_plain").groupBy(F.floor(F.col("chan") / 2).alias("slab"), "block").agg(F.count(F.lit(1)).alias("n"))
    path = _folder(spark, "planes")
    planes.repartition(4, "block").write.parquet(path)
    stream = spark.readStream.schema("slab long, block int, n long").option("maxFilesPerTrigger", 1).parquet(path)
    return slabs.run_once(slabs.complete_slabs(stream, 7), f"q79_{uuid.uuid4().hex}", _folder(spark, "q79"))


QUERIES["q79"] = slabs_across_blocks
ORACLES["q79"] = fixtures.oracle("select chan//2 as slab, count(distinct block) as blocks, count(*) as n from fx_plain group by chan//2")


def hourly(spark, sf_dir):
    """Tumbling windows by a stream in complete mode."""
    events = slabs.event_stream(spark, sf_dir)
    return _plain(slabs.run_once(slabs.tumbling(events), f"q80_{uuid.uuid4().hex}", _folder(spark, "q80"), "complete"))


QUERIES["q80"] = hourly
ORACLES["q80"] = "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all"


@query("q81", "select (h - to_hours(k)) as start, count(*) as n from (select date_trunc('hour', ts) as h from events) e cross join (values (0), (1)) v(k) group by all")
def two_hours(v):
    return _plain(slabs.sliding(v("events").withColumn("ts", F.col("ts").cast("timestamp"))))


@query("q82", "select user_id, min(ts) as start, count(*) as n from (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval 30 minute then 0 else 1 end as new from events) a) b group by user_id, s")
def user_sessions(v):
    return _plain(slabs.sessions(v("events").withColumn("ts", F.col("ts").cast("timestamp"))))
