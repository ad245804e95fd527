"""Scans, projections, filters, joins and blocks (q01-q36, q60, q85)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sky, units
from ..operators import ingest as op
from .registry import query, r

C = "299792458.0e0"


@query("q01", "select name, row_number() over (order by name) - 1 as place from fx_beam where lower(name) like '%.ms' and name not like '.%'")
def listed_files(v):
    return op.listed(v("fx_beam")).select("name", F.col("place").cast("long").alias("place"))


@query("q02", "select beam, name, cast(regexp_extract(name, 'C10[_-]([0-9]+)', 1) as int) as number, row_number() over (order by cast(regexp_extract(name, 'C10[_-]([0-9]+)', 1) as int), name) - 1 as place from fx_beam")
def natural_order(v):
    return op.beam_numbers(v("fx_beam")).select("beam", "name", "number", (F.row_number().over(Window.orderBy("number", "name")) - 1).cast("long").alias("place"))


@query(
    "q03",
    """select vis_id, round(0.5e0*(p0_re+p1_re), 8)+0.0e0 as re, round(0.5e0*(p0_im+p1_im), 8)+0.0e0 as im, round(0.5e0*sqrt(s0*s0+s1*s1), 6) as sigma,
 round(0.5e0*sqrt(1.0e0/greatest(w0,1.0e-12)/greatest(w0,1.0e-12)*greatest(w0,1.0e-12) + 1.0e0/greatest(w1,1.0e-12)), 6) as sigma_w, (f0 or f1) as flag from fx_vis""",
)
def stokes(v):
    raw = v("fx_vis")
    by_weight = op.sigma_i(units.sigma_of_weight(F.col("w0")), units.sigma_of_weight(F.col("w1")))
    s = op.to_stokes(raw.withColumn("sigma_w", by_weight))
    return s.select("vis_id", r("re", 8).alias("re"), r("im", 8).alias("im"), F.round("sigma", 6).alias("sigma"), F.round("sigma_w", 6).alias("sigma_w"), "flag")


@query("q04", "select beam, ddid, count(*) as n from fx_sky where (beam in (0, 2) and ddid = 0) or (beam = 1 and ddid = 1) group by beam, ddid")
def spectral_windows(v):
    vis = v("fx_sky")
    spark = vis.sparkSession
    description = spark.range(2).select(F.col("id").cast("int").alias("ddid"), F.col("id").cast("int").alias("spw"))
    wanted = spark.sql("select * from values (0, 0), (1, 1), (2, 0) as t(beam, spw)")
    return op.by_spw(vis, description, wanted).groupBy("beam", "ddid").agg(F.count(F.lit(1)).alias("n"))


@query("q05", "select s.ddid as spw, count(*) as nchan, min(frequency) as fmin, max(frequency) as fmax from (select distinct ddid, chan from fx_sky) s join fx_channel c on s.chan = c.chan group by s.ddid")
def window_summaries(v):
    pairs = v("fx_sky").select("ddid", "chan").distinct()
    return op.with_channel(pairs, v("fx_channel")).groupBy(F.col("ddid").alias("spw")).agg(F.count(F.lit(1)).alias("nchan"), F.min("frequency").alias("fmin"), F.max("frequency").alias("fmax"))


@query("q06", f"select chan, round(v, 6)+0.0e0 as velocity, round(1.42040575177e9 - v*(1.42040575177e9/({C}/1000.0e0)), 2) as frequency from (select chan, (1.42040575177e9 - frequency)/1.42040575177e9*({C}/1000.0e0) as v from fx_channel) t")
def velocity_axis(v):
    t = v("fx_channel").withColumn("v", units.velocity(F.col("frequency")))
    return t.select("chan", r("v", 6).alias("velocity"), F.round(units.frequency_of(F.col("v")), 2).alias("frequency"))


_TICKS = """lpad(cast(t // 3600000 as varchar), 2, '0') || ':' || lpad(cast((t // 60000) % 60 as varchar), 2, '0') || ':' || lpad(cast((t % 60000) // 1000 as varchar), 2, '0') || '.' || lpad(cast(t % 1000 as varchar), 3, '0')"""


@query("q07", f"select beam, max(case when k = 0 then s || {_TICKS} end) as ra, max(case when k = 1 then s || {_TICKS} end) as dec from (select beam, k, case when x < 0 then '-' else '+' end as s, cast(round(abs(x)*3600000.0e0) as bigint) as t from (select beam, 0 as k, ra_deg/15.0e0 as x from fx_beam union all select beam, 1, dec_deg from fx_beam) a) b group by beam")
def phase_centre(v):
    return v("fx_beam").select("beam", sky.sexagesimal(F.col("ra_deg") / 15).alias("ra"), sky.sexagesimal(F.col("dec_deg")).alias("dec"))


@query("q08", "select b.beam, count(s.beam) as nvis, cast(coalesce(sum(case when not s.flag then 1 else 0 end), 0) as bigint) as ngood from fx_beam b left join fx_sky s on b.beam = s.beam group by b.beam")
def block(v):
    return op.load_block(v("fx_sky"), v("fx_beam"))


@query("q09", f"select s.beam, count(*) as n, round(sum(re), 4) as re from fx_sky s join fx_channel c on s.chan = c.chan where s.chan = 2 and not flag and ant1 <> ant2 and sqrt(uu*uu+vv*vv)*frequency/{C} between 200.0e0 and 900.0e0 group by s.beam")
def one_channel(v):
    vis = op.cross_only(op.select_channels(v("fx_sky"), [2])).where(~F.col("flag"))
    return op.within_uv_lambda(vis, v("fx_channel"), 200.0, 900.0).groupBy("beam").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("re"), 4).alias("re"))


@query("q10", "select row_number() over (order by beam, vis_id) as place, vis_id, beam, round(-im, 6)+0.0e0 as im from fx_stokes where chan = 1 and block in (0, 1)")
def flat_concat(v):
    vis = v("fx_stokes").where("chan = 1")
    both = op.merge([vis.where("block = 0"), vis.where("block = 1")])
    return op.numbered(both, "beam", "vis_id").select("place", "vis_id", "beam", r(-F.col("im"), 6).alias("im"))


@query("q11", "select chan, y, x, round(value, 6)+0.0e0 as value from fx_image where chan in (1, 3, 4)")
def cube_planes(v):
    return op.select_channels(v("fx_image"), [1, 3, 4]).select("chan", "y", "x", r("value", 6).alias("value"))


@query("q12", "select chan, round(min(value), 6)+0.0e0 as lo, round(max(value), 6)+0.0e0 as hi, round(avg(value), 6)+0.0e0 as mean from fx_image group by chan")
def plane_statistics(v):
    return v("fx_image").groupBy("chan").agg(r(F.min("value"), 6).alias("lo"), r(F.max("value"), 6).alias("hi"), r(F.avg("value"), 6).alias("mean"))


@query("q13", f"select vis_id, round(uu*(frequency/{C}), 5)+0.0e0 as u_lambda, round(vv*(frequency/{C}), 5)+0.0e0 as v_lambda, round(uu*(frequency/{C})*2.0e0*pi()*(7.0e0*pi()/648000.0e0), 8)+0.0e0 as u_radpix from fx_stokes s join fx_channel c on s.chan = c.chan")
def uv_units(v):
    t = op.with_channel(v("fx_stokes"), v("fx_channel"))
    u, w = (units.to_lambda(F.col(c), F.col("frequency")) for c in ("uu", "vv"))
    return t.select("vis_id", r(u, 5).alias("u_lambda"), r(w, 5).alias("v_lambda"), r(units.to_radpix(u, 7.0), 8).alias("u_radpix"))


@query("q14", "select beam, chan, round(sum(re), 4) as re, round(sum(-im), 4) as im from fx_sky group by beam, chan")
def conjugate(v):
    return v("fx_sky").groupBy("beam", "chan").agg(F.round(F.sum("re"), 4).alias("re"), F.round(F.sum(-F.col("im")), 4).alias("im"))


_K = f"({C}*{C})/(2.0e0*1.380649e-23*c.frequency*c.frequency)*(1.0e-26/pow(pi()/648000.0e0,2.0e0))"


@query("q15", f"select i.chan, i.y, i.x, round(i.value*({_K}), 2)+0.0e0 as t_k, round(1000.0e0*i.value/({_K}), 6)+0.0e0 as s from fx_image i join fx_channel c on i.chan = c.chan")
def brightness(v):
    t = op.with_channel(v("fx_image"), v("fx_channel"))
    return t.select("chan", "y", "x", r(units.jy_arcsec2_to_k(F.col("value"), F.col("frequency")), 2).alias("t_k"), r(1000 * units.k_to_jy_arcsec2(F.col("value"), F.col("frequency")), 6).alias("s"))


@query("q16", f"select i.chan, y, x, round(1000.0e0*value/(60.0e0*40.0e0*pi()/(4.0e0*ln(2.0e0))), 7)+0.0e0 as per_arcsec2, round(value*(21.0e0*21.0e0*pi()/(4.0e0*ln(2.0e0))), 3)+0.0e0 as per_beam, round(1000.0e0*value/({_K})/2.0e0, 6)+0.0e0 as sd from fx_image i join fx_channel c on i.chan = c.chan")
def beam_units(v):
    t, x = op.with_channel(v("fx_image"), v("fx_channel")), F.col("value")
    # a restoring beam of three 7" pixels; single-dish K to Jy/arcsec², halved for the I convention
    return t.select("chan", "y", "x", r(1000 * x / units.beam_area(60.0, 40.0), 7).alias("per_arcsec2"), r(x * units.beam_area(21.0, 21.0), 3).alias("per_beam"), r(1000 * units.k_to_jy_arcsec2(x, F.col("frequency")) / 2, 6).alias("sd"))


@query("q17", "select chan, round(5.0e4 + (chan + 1 - 2.0e0)*1649.0e0, 3) as axis, round((chan/10.0e0)*(0.211e0*3437.75e0), 5) as baseline from fx_channel")
def axes(v):
    return v("fx_channel").select("chan", F.round(units.spectral_axis(F.col("chan"), 5.0e4, 2.0, 1649.0), 3).alias("axis"), F.round(units.baseline_of_k(F.col("chan") / 10), 5).alias("baseline"))


@query("q18", f"select round(max(greatest(abs(uu),abs(vv)))*(select max(frequency)-min(frequency) from fx_channel)/{C}, 6) as drift, max(greatest(abs(uu),abs(vv)))*(select max(frequency)-min(frequency) from fx_channel)/{C} < 5.0e0 as safe, false as rising, true as falling, round(avg(sqrt(1.0e0/w0)), 6) as sigma, round(avg(w0/4.0e0), 6) as scaled from fx_plain")
def channel_safety(v):
    raw, channels = v("fx_plain"), v("fx_channel")
    weights = raw.agg(F.round(F.avg(F.sqrt(1 / F.col("w0"))), 6).alias("sigma"), F.round(F.avg(F.col("w0") / 4), 6).alias("scaled"))
    drift = op.largest_drift(raw, channels).select(F.round("drift", 6).alias("drift"), (F.col("drift") < 5).alias("safe"))
    return drift.crossJoin(op.order_is_strict(channels)).crossJoin(weights)


@query("q19", "select beam, round(20.0e0*(cos(radians(dec_deg))*cos(radians(-70.0e0))*cos(radians(ra_deg-75.0e0))+sin(radians(dec_deg))*sin(radians(-70.0e0))), 6) as dv, round((ra_deg-75.0e0)*cos(radians(30.0e0))-(dec_deg+70.0e0)*sin(radians(30.0e0)), 6)+0.0e0 as dx, round((ra_deg-75.0e0)*sin(radians(30.0e0))+(dec_deg+70.0e0)*cos(radians(30.0e0)), 6)+0.0e0 as dy from fx_beam")
def field_corrections(v):
    dx, dy = sky.rotated(F.col("ra_deg") - 75.0, F.col("dec_deg") + 70.0, 30.0)
    return v("fx_beam").select("beam", F.round(sky.field_velocity(F.col("ra_deg"), F.col("dec_deg"), 75.0, -70.0), 6).alias("dv"), r(dx, 6).alias("dx"), r(dy, 6).alias("dy"))


@query("q20", "select chan, y, x, round(pow(least(greatest((value+1.0e0)/6.0e0, 0.0e0), 1.0e0), 0.6e0), 6) as shown from fx_image")
def display(v):
    from ..functions import display as d

    return v("fx_image").select("chan", "y", "x", F.round(d.stretch(F.col("value"), -1.0, 5.0, 0.6), 6).alias("shown"))


@query("q21", "select beam, chan, count(*) as n, round(sum(re), 4) as re from fx_sky where ant1 <> ant2 and not flag group by beam, chan")
def cross_correlations(v):
    return op.cross_only(v("fx_sky")).where(~F.col("flag")).groupBy("beam", "chan").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("re"), 4).alias("re"))


@query("q22", "select beam, count(*) as n, cast(count_if(flag or not b) as bigint) as flagged, cast(count_if(not b) as bigint) as infinite, round(sum(case when b then sigma else 0.0e0 end), 4) as sigma from (select beam, flag, sigma, sqrt(uu*uu+vv*vv+ww*ww) between 20.0e0 and 250.0e0 as b from fx_sky) t group by beam")
def uv_flags(v):
    t = op.flag_uv_range(v("fx_sky"), 20.0, 250.0)
    far = F.col("sigma") == float("inf")
    return t.groupBy("beam").agg(F.count(F.lit(1)).alias("n"), F.count_if("flag").alias("flagged"), F.count_if(far).alias("infinite"), F.round(F.sum(F.when(far, 0.0).otherwise(F.col("sigma"))), 4).alias("sigma"))


@query("q23", "select c.chan, c.beam, c.n, m.most from (select chan, beam, count(*) as n from fx_sky where not flag group by chan, beam) c join (select beam, max(n) as most from (select chan, beam, count(*) as n from fx_sky where not flag group by chan, beam) d group by beam) m on c.beam = m.beam")
def group_counts(v):
    c = op.counts(v("fx_sky"))
    return c.select("chan", "beam", "n", F.max("n").over(Window.partitionBy("beam")).alias("most"))


@query("q24", "select distinct chan, beam from fx_sky where chan >= 1 and chan < 6 and (chan - 1) % 2 = 0 and beam in (0, 3)")
def selections(v):
    return op.select_beams(op.select_channels(v("fx_sky"), slice(1, 6, 2)), [3, 0, 3], 4).select("chan", "beam").distinct()


@query("q25", "select chan, frequency from fx_channel order by abs(frequency - 1.4209e9), chan limit 1")
def closest_channel(v):
    return op.nearest_channel(v("fx_channel"), 1.4209e9)


_SEP = "degrees(2.0e0*asin(sqrt(pow(sin(radians(dec_deg-(-69.0e0))/2.0e0),2.0e0)+cos(radians(dec_deg))*cos(radians(-69.0e0))*pow(sin(radians(ra_deg-76.0e0)/2.0e0),2.0e0))))"


@query("q26", f"select beam, round({_SEP}, 8) as sep, {_SEP} <= 0.7e0 as inside from fx_beam")
def cone(v):
    beams = v("fx_beam")
    inside = op.in_cone(beams, 76.0, -69.0, 0.7).select("beam", F.lit(True).alias("hit"))
    return beams.join(inside, "beam", "left").select("beam", F.round(sky.separation(F.col("ra_deg"), F.col("dec_deg"), 76.0, -69.0), 8).alias("sep"), F.coalesce("hit", F.lit(False)).alias("inside"))


HEADER = {"CRVAL1": 76.0, "CRVAL2": -69.5, "CRPIX1": 33.0, "CRPIX2": 33.0, "CDELT1": -0.05, "CDELT2": 0.05}


@query("q27", """select beam, round(px, 5)+0.0e0 as px, round(py, 5)+0.0e0 as py, px between 0 and 63 and py between 0 and 63 as inside from (select beam,
 degrees(cos(radians(dec_deg))*sin(radians(ra_deg-76.0e0)))/(-0.05e0)+32.0e0 as px,
 degrees(sin(radians(dec_deg))*cos(radians(-69.5e0))-cos(radians(dec_deg))*sin(radians(-69.5e0))*cos(radians(ra_deg-76.0e0)))/0.05e0+32.0e0 as py from fx_beam) t""")
def footprint(v):
    px, py = sky.to_pixel(F.col("ra_deg"), F.col("dec_deg"), HEADER)
    t = v("fx_beam").select("beam", px.alias("px"), py.alias("py"))
    return t.select("beam", r("px", 5).alias("px"), r("py", 5).alias("py"), (F.col("px").between(0, 63) & F.col("py").between(0, 63)).alias("inside"))


@query("q28", "select p.beam, count(*) as n, cast(count_if(p.value > 0.2e0) as bigint) as kept, round(sum(case when p.value > 0.2e0 then i.value else 0.0e0 end), 5)+0.0e0 as total from fx_pb p join fx_image i on p.y = i.y and p.x = i.x and i.chan = 0 group by p.beam")
def beam_mask(v):
    from ..operators import images as im

    masked = im.masked(v("fx_image").where("chan = 0"), v("fx_pb"), 0.2)  # NaN where the beam is weak
    return masked.groupBy("beam").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.isnan("value")).alias("kept"), r(F.sum(F.nanvl("value", F.lit(0.0))), 5).alias("total"))


@query("q29", "select chan, y, x, round(value, 6)+0.0e0 as value from fx_image where y >= 2 and y < 6 and x >= 2 and x < 6")
def centre_crop(v):
    from ..operators import images as im

    return im.crop_centre(v("fx_image"), 8, 8, 0.5).select("chan", "y", "x", r("value", 6).alias("value"))


@query("q30", "select block, count(*) as n from fx_sky where block in (select block from (select distinct block from fx_sky) b order by block limit 3) group by block")
def first_three_blocks(v):
    return op.first_blocks(v("fx_sky"), 3).groupBy("block").agg(F.count(F.lit(1)).alias("n"))


@query("q31", "select beam, count(*) as n, round(sum(re), 4) as re from fx_sky where block in (0, 1, 2) group by beam")
def merged(v):
    vis, beams = v("fx_sky"), v("fx_beam")
    return op.merge([vis.where(f"block = {b}") for b in range(3)], [beams] * 3).groupBy("beam").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("re"), 4).alias("re"))


@query("q32", "select cast(beam + o as int) as beam, count(*) as n from fx_sky join (select block as b, coalesce(sum(nbeam) over (order by block rows between unbounded preceding and 1 preceding), 0) as o from (select block, max(beam)+1 as nbeam from fx_sky group by block) t) s on block = b group by cast(beam + o as int)")
def stacked(v):
    return op.stack(v("fx_sky")).groupBy("beam").agg(F.count(F.lit(1)).alias("n"))


@query("q33", "select s.beam, b.name, count(*) as n, round(avg(p.value), 6) as pb from fx_sky s join fx_beam b on s.beam = b.beam join (select beam, value from fx_pb where y = 4 and x = 4) p on p.beam = b.beam group by s.beam, b.name")
def beam_join(v):
    t = op.with_beam(op.with_beam(v("fx_sky"), v("fx_beam")), v("fx_pb").where("y = 4 and x = 4").select("beam", "value"))
    return t.groupBy("beam", "name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("pb"))


@query("q34", "select a.beam, abs(0.0005e0*a.beam) > 0.001e0 as moved from fx_beam a")
def centre_check(v):
    beams = v("fx_beam")
    bad = op.mismatched_centres(beams, beams.withColumn("ra_deg", F.col("ra_deg") + 0.0005 * F.col("beam")), 0.001 + 1e-9).withColumn("m", F.lit(True))
    return beams.join(bad, "beam", "left").select("beam", F.coalesce("m", F.lit(False)).alias("moved"))


@query("q35", "select a.y, a.x, round(a.value*(1.0e0-w) + b.value*w, 6)+0.0e0 as value from (select c.chan, d.chan as nxt, (1.4209e9 - c.frequency)/(d.frequency - c.frequency) as w from fx_channel c join fx_channel d on d.chan = c.chan - 1 where c.frequency <= 1.4209e9 and 1.4209e9 < d.frequency) t join fx_image a on a.chan = t.chan join fx_image b on b.chan = t.nxt and a.y = b.y and a.x = b.x")
def plane_at_frequency(v):
    from ..operators import images as im

    return im.plane_at(v("fx_image"), v("fx_channel"), 1.4209e9).select("y", "x", r("value", 6).alias("value"))


@query("q36", "select b.name, i.chan from (select name, row_number() over (order by name) as k from fx_beam) b join (select chan, row_number() over (order by chan) as k from fx_channel) i using (k)")
def by_place(v):
    a = v("fx_beam").select("name", F.row_number().over(Window.orderBy("name")).alias("k"))
    b = v("fx_channel").select("chan", F.row_number().over(Window.orderBy("chan")).alias("k"))
    return a.join(b, "k").select("name", "chan")


@query("q60", "select row_number() over (order by c0) - 1 as slab, c0, c1, n from (select min(chan) as c0, max(chan)+1 as c1, count(*) as n from (select chan, isl, (row_number() over (partition by isl order by chan)-1)//2 as part from (select chan, chan - row_number() over (order by chan) as isl from fx_channel where chan <> 3) a) b group by isl, part) t")
def channel_slabs(v):
    return op.slabs(v("fx_channel").where("chan <> 3"), 2).select(F.col("slab").cast("long").alias("slab"), "c0", "c1", "n")


@query("q85", "select chan, round(sqrt(re*re+im*im), 5) as amplitude from (select chan, 0.5e0*(avg(p0_re)+avg(p1_re)) as re, 0.5e0*(avg(p0_im)+avg(p1_im)) as im from fx_plain where ant1 % 12 = 2 and ant2 % 12 = 3 group by chan) t")
def baseline_spectrum(v):
    rows = v("fx_plain").where("ant1 % 12 = 2 and ant2 % 12 = 3")
    t = rows.groupBy("chan").agg((0.5 * (F.avg("p0_re") + F.avg("p1_re"))).alias("re"), (0.5 * (F.avg("p0_im") + F.avg("p1_im"))).alias("im"))
    return t.select("chan", F.round(F.hypot("re", "im"), 5).alias("amplitude"))


@query("q85_pair", "select chan, round(sqrt(re*re+im*im), 5) as amplitude from (select chan, 0.5e0*(avg(p0_re)+avg(p1_re)) as re, 0.5e0*(avg(p0_im)+avg(p1_im)) as im from fx_plain where ant1 = 2 and ant2 = 3 group by chan) t")
def baseline_pair_spectrum(v):
    rows = v("fx_plain").where("ant1 = 2 and ant2 = 3")
    t = rows.groupBy("chan").agg((0.5 * (F.avg("p0_re") + F.avg("p1_re"))).alias("re"), (0.5 * (F.avg("p0_im") + F.avg("p1_im"))).alias("im"))
    return t.select("chan", F.round(F.hypot("re", "im"), 5).alias("amplitude"))
