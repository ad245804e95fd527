"""Deterministic views that derive visibility tables from the driver's tables, as SQL both engines run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "fx_vis": """
select cast(row_number() over (order by l_orderkey,l_linenumber,l_partkey,l_suppkey,l_shipdate,l_extendedprice,l_quantity) - 1 as bigint) as vis_id,
 cast(year(l_shipdate) - 1995 as int) as block, cast(l_suppkey % 4 as int) as beam, cast(case when l_linestatus='O' then 0 else 1 end as int) as ddid,
 cast(l_linenumber - 1 as int) as chan, cast(l_partkey % 36 as int) as ant1, cast(l_suppkey % 36 as int) as ant2, l_shipdate as obs_time,
 cast(l_partkey % 401 - 200 as double) as uu, cast(l_orderkey % 401 - 200 as double) as vv, cast(l_orderkey % 21 - 10 as double) as ww,
 l_quantity/10.0e0 as p0_re, l_discount*10.0e0 as p0_im, l_extendedprice/10000.0e0 as p1_re, l_tax*10.0e0 as p1_im,
 1.0e0 + l_tax*100.0e0 as w0, 1.0e0 + l_discount*100.0e0 as w1, 0.5e0 + l_tax*10.0e0 as s0, 0.5e0 + l_discount*10.0e0 as s1,
 l_returnflag='R' as f0, l_discount > 0.085e0 as f1 from lineitem""",
    "fx_channel": "select distinct cast(l_linenumber - 1 as int) as chan, 1.42040575177e9 + (3 - (l_linenumber - 1))*1.0e6 as frequency from lineitem",
    "fx_beam": """
select cast(s_suppkey as int) as beam, 75.0e0 + s_suppkey*0.7e0 as ra_deg, -70.0e0 + s_suppkey*0.3e0 as dec_deg,
 concat('MW-C10_', cast(s_suppkey as varchar(20)), '_chan.ms') as name from supplier where s_suppkey < 6""",
    "fx_image": """
select c.chan, cast(floor(p_partkey/8) as int) as y, cast(p_partkey % 8 as int) as x, (p_size - 10)/10.0e0*(1.0e0 + 0.1e0*c.chan) as value
 from part cross join fx_channel c where p_partkey < 64""",
    "fx_pb": "select b.beam, i.y, i.x, exp(-((i.x-3.5e0)*(i.x-3.5e0)+(i.y-3.5e0)*(i.y-3.5e0))/(8.0e0+b.beam)) as value from fx_beam b cross join (select y,x from fx_image where chan=0) i",
    "fx_grid": "select b.beam, i.y, i.x, (i.x/7.0e0*2.0e0-1.0e0)*0.9e0 + 0.013e0*b.beam as gx, (i.y/7.0e0*2.0e0-1.0e0)*0.9e0 - 0.017e0*b.beam as gy from fx_beam b cross join (select y,x from fx_image where chan=0) i",
    "fx_stokes": """
select vis_id, block, beam, ddid, chan, ant1, ant2, uu, vv, ww, 0.5e0*(p0_re+p1_re) as re, 0.5e0*(p0_im+p1_im) as im,
 0.5e0*sqrt(s0*s0+s1*s1) as sigma, (f0 or f1) as flag from fx_vis""",
}
#: Visibilities with an id of their own columns: no sort of all of them either.
_ID = "concat(" + ", '-', ".join(f"cast({c} as varchar(20))" for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "year(l_shipdate)*10000 + month(l_shipdate)*100 + day(l_shipdate)")) + ")"
VIEWS["fx_keyed_vis"] = f"select {_ID} as vis_id, " + VIEWS["fx_vis"].split("as vis_id,", 1)[1]
VIEWS["fx_keyed"] = VIEWS["fx_stokes"].replace("from fx_vis", "from fx_keyed_vis")
#: An image of four pixels a part, 100 a row, and a cube with a spectrum for each part: both grow with the tables.
VIEWS["fx_field"] = """
select cast(floor(n/100) as int) as y, cast(n % 100 as int) as x, value from
 (select p_partkey*4 + q as n, (p_size - 10)/10.0e0*(1.0e0 + 0.1e0*q) as value from part cross join (select 0 as q union all select 1 union all select 2 union all select 3) s) t"""
VIEWS["fx_cube"] = """
select c.chan, cast(floor(p.p_partkey/100) as int) as y, cast(p.p_partkey % 100 as int) as x, coalesce(sum(l.l_quantity), 0)/10.0e0 as value
 from part p cross join fx_channel c left join lineitem l on l.l_partkey = p.p_partkey and l.l_linenumber - 1 = c.chan group by c.chan, p.p_partkey"""
BASIS = {
    "spark": "select cast(vec_id as int) as k, pos as chan, cast(val as double) as value from (select vec_id, posexplode(embedding) as (pos,val) from embeddings where vec_id < 3)",
    "duckdb": "select cast(vec_id as int) as k, cast(g-1 as int) as chan, cast(embedding[g] as double) as value from (select vec_id, embedding, unnest(range(1,len(embedding)+1)) as g from embeddings where vec_id < 3)",
}
_KEYS = re.search(r"order by (.*?)\)", VIEWS["fx_vis"])[1]
_BUCKET = "coalesce(shiftright(l_orderkey, 10), 9223372036854775807)"
#: For Spark, the same ids without one task that sorts all samples: numbers within 1024 order keys, after the samples of those before.
#: Nulls come last, as DuckDB has them.
NUMBERED = f"""
select cast(earlier + own as bigint) - 1 as vis_id, {VIEWS["fx_vis"].split("as vis_id,", 1)[1].removesuffix(" from lineitem")} from
 (select *, row_number() over (partition by bucket order by {", ".join(f"{c} nulls last" for c in _KEYS.split(","))}) as own from (select *, {_BUCKET} as bucket from lineitem) k) t
 join (select bucket, sum(n) over (order by bucket) - n as earlier from (select {_BUCKET} as bucket, count(*) as n from lineitem group by {_BUCKET}) c) b on b.bucket = t.bucket"""
#: Visibilities without an id: the same rows, and no sort of all of them.
VIEWS["fx_plain"] = "select " + VIEWS["fx_vis"].split("as vis_id,", 1)[1]
VIEWS["fx_sky"] = VIEWS["fx_stokes"].replace("select vis_id, ", "select ").replace("from fx_vis", "from fx_plain")


def _needed(sql: str, views: dict[str, str]) -> list[str]:
    found: list[str] = []

    def visit(text: str) -> None:
        for name in views:
            if name not in found and re.search(rf"\b{name}\b", text):
                if name not in TABLES:
                    visit(views[name])
                found.append(name)

    visit(sql)
    return found


def _with(sql: str, views: dict[str, str]) -> str:
    parts = [f"{n} as ({views[n].strip()})" for n in _needed(sql, views)]
    if not parts:
        return sql
    sql = sql.strip()
    if sql[:5].lower() == "with ":
        return "with " + ",\n".join(parts) + ",\n" + sql[5:]
    return "with " + ",\n".join(parts) + "\n" + sql


def oracle(sql: str) -> str:
    """``sql`` for DuckDB, with the views that it needs."""
    return _with(sql, VIEWS | {"fx_basis": BASIS["duckdb"]})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a driver's table, as a DataFrame over the Parquet files of ``sf_dir``."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    files = {t: f"select * from parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    return spark.sql(_with(f"select * from {name}", files | VIEWS | {"fx_vis": NUMBERED, "fx_basis": BASIS["spark"]}))
