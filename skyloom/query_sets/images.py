"""Images, spectra, mosaics and spectral models (q48-q59, q61, q65-q73, q75, q76, q78)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import images as im
from ..operators import mosaic, spectra, spectral
from .imaging import TAPER, dft_sql
from .registry import query, r


@query("q48", "select beam, chan, round(sum((w0*p0_re+w1*p1_re)/(w0+w1)), 3) as re, round(sum(w0+w1), 3) as weight, bool_or(f0 or f1) as flag from fx_plain group by beam, chan")
def polarisations(v):
    t = mosaic.weighted_polarisations(v("fx_plain"))
    return t.groupBy("beam", "chan").agg(F.round(F.sum("re"), 3).alias("re"), F.round(F.sum("weight"), 3).alias("weight"), F.bool_or("flag").alias("flag"))


@query("q49", "select y, x, round(m/max(m) over (), 8) as mean, round(s/max(s) over (), 8) as rss from (select y, x, avg(value) as m, sqrt(sum(value*value)) as s from fx_pb group by y, x) t")
def effective_beam(v):
    a, b = mosaic.effective_beam(v("fx_pb")), mosaic.effective_beam(v("fx_pb"), "rss").withColumnRenamed("value", "rss")
    return a.join(b, ["y", "x"]).select("y", "x", F.round("value", 8).alias("mean"), F.round("rss", 8).alias("rss"))


@query("q50", "select p.y, p.x, round(sum(p.value*p.value*i.value)/sum(p.value*p.value), 7)+0.0e0 as value, round(sqrt(sum(p.value*p.value)), 8) as pb from fx_pb p join fx_image i on i.y = p.y and i.x = p.x and i.chan = p.beam where p.value >= 0.05e0 group by p.y, p.x")
def linear_mosaic(v):
    tiles = v("fx_image").withColumnRenamed("chan", "beam")
    return mosaic.linear(tiles, v("fx_pb"), 0.05).select("y", "x", r("value", 7).alias("value"), F.round("pb", 8).alias("pb"))


_RING = "round_even(sqrt(pow(case when x>=4 then x-8 else x end,2.0e0)+pow(case when y>=4 then y-8 else y end,2.0e0)), 0)"


@query("q51", f"with d as ({dft_sql('fx_image')}) select chan, cast({_RING} as int) as k, round(avg((re*re+im*im)/64.0e0), 5) as pk, count(*) as n from d where {_RING} between 1 and 2 group by chan, cast({_RING} as int)")
def power_spectrum(v):
    t = spectra.rings(spectra.power(v("fx_image"), None, 8, 8), 8, 8)
    return t.select("chan", "k", F.round("pk", 5).alias("pk"), "n")


@query("q52", f"with a as ({dft_sql('(select * from fx_image where chan=0)', chan='')}), b as ({dft_sql('(select y, x, value*value as value from fx_image where chan=1)', chan='')}), c as (select a.y, a.x, (a.re*b.re+a.im*b.im)/64.0e0 as p from a join b on a.y=b.y and a.x=b.x) select cast({_RING} as int) as k, round(avg(p), 5)+0.0e0 as pk from c where {_RING} between 1 and 2 group by cast({_RING} as int)")
def cross_spectrum(v):
    image = v("fx_image")
    a, b = image.where("chan = 0"), image.where("chan = 1").select(F.lit(0).alias("chan"), "y", "x", (F.col("value") * F.col("value")).alias("value"))
    return spectra.rings(spectra.power(a, b, 8, 8), 8, 8).select("k", r("pk", 5).alias("pk"))


@query("q53", f"with d as ({dft_sql('fx_image')}), p as (select chan, (re*re+im*im)/64.0e0 as p, sqrt(pow((case when x>=4 then x-8 else x end)/(8.0e0*(7.0e0/60.0e0)),2.0e0)+pow((case when y>=4 then y-8 else y end)/(8.0e0*(7.0e0/60.0e0)),2.0e0)) as k from d), e as (select 1.0e0/(8.0e0*(7.0e0/60.0e0)) as lo, sqrt(2.0e0)*4.0e0/(8.0e0*(7.0e0/60.0e0)) as hi), b as (select cast(g as int) as bin, lo+(hi-lo)*g/4.0e0 as f0, lo+(hi-lo)*(g+1)/4.0e0 as f1 from e cross join (select unnest(range(0, 4)) as g) s) select c.chan, b.bin, round((f0+f1)/2.0e0, 6) as centre, round(coalesce(avg(p), 0.0e0), 5) as pk from b cross join (select distinct chan from fx_image) c left join p on p.chan = c.chan and p.k > f0*(1.0e0+1.0e-12) and p.k <= f1*(1.0e0+1.0e-12) group by c.chan, b.bin, f0, f1")
def binned_spectrum(v):
    t = spectra.linear_bins(spectra.power(v("fx_image"), None, 8, 8), 8, 8, 7.0, 4)
    return t.select("chan", "bin", F.round("centre", 6).alias("centre"), F.round("pk", 5).alias("pk"))


@query("q54", "select chan, round(quantile_cont(value, 0.05), 6)+0.0e0 as lo, round(quantile_cont(value, 0.997), 6)+0.0e0 as hi from fx_image group by chan")
def display_limits(v):
    return spectra.percentiles(v("fx_image"), 0.05, 0.997).select("chan", r("lo", 6).alias("lo"), r("hi", 6).alias("hi"))


_SPEC = "(select y + 1 as k, sum(value*value) + 1.0e0 as pk from fx_image where chan = {c} group by y)"


def _spectrum(v, chan):
    return v("fx_image").where(F.col("chan") == chan).groupBy((F.col("y") + 1).alias("k")).agg((F.sum(F.col("value") * F.col("value")) + 1.0).alias("pk"))


@query("q55", f"select round(sum(a.pk*b.pk)/sum(b.pk*b.pk), 8) as factor from {_SPEC.format(c=0)} a join {_SPEC.format(c=3)} b on a.k = b.k where a.k > 2")
def noise_factor(v):
    return spectra.noise_scale(_spectrum(v, 0), _spectrum(v, 3), 2).select(F.round("factor", 8).alias("factor"))


@query("q56", f"select round(fwhm, 6) as fwhm, round(m, 6) as misfit from (select fwhm, var_pop(ln(pk) + pow(pi()*fwhm*k,2.0e0)/(4.0e0*ln(2.0e0))*2.0e0) as m from (select k/16.0e0 as k, pk from {_SPEC.format(c=0)} s) t cross join (select 0.1e0 + g*(4.9e0/1999) as fwhm from (select unnest(range(0, 2000)) as g) u) f group by fwhm) z order by m, fwhm limit 1")
def spectrum_fit(v):
    s = _spectrum(v, 0).withColumn("k", F.col("k") / 16.0)
    return spectra.gaussian_fit(s, 0.1, 5.0, 2000).select(F.round("fwhm", 6).alias("fwhm"), F.round("misfit", 6).alias("misfit"))


@query("q57", "select block, min(obs_time) as first, max(obs_time) as last, count(*) as n, round(avg(date_diff('day', date '1995-01-01', cast(obs_time as date))), 4) as mean_day from fx_plain group by block")
def observation_times(v):
    day = F.datediff(F.to_date("obs_time"), F.lit("1995-01-01").cast("date"))
    return v("fx_plain").groupBy("block").agg(F.min("obs_time").alias("first"), F.max("obs_time").alias("last"), F.count(F.lit(1)).alias("n"), F.round(F.avg(day), 4).alias("mean_day"))


@query("q58", "select beam, round(avg(s), 6)+0.0e0 as mean, round(stddev_samp(s), 6) as spread from (select beam, block, sum(re)/count(*) as s from fx_sky group by beam, block) t group by beam")
def coefficient_statistics(v):
    each = v("fx_sky").groupBy("beam", "block").agg((F.sum("re") / F.count(F.lit(1))).alias("s"))
    return each.groupBy("beam").agg(r(F.avg("s"), 6).alias("mean"), F.round(F.stddev_samp("s"), 6).alias("spread"))


@query("q59", "select block, beam, chan, count(*) as n, cast(count_if(flag) as bigint) as flagged from fx_sky group by rollup(block, beam, chan)")
def quality_rollup(v):
    return v("fx_sky").rollup("block", "beam", "chan").agg(F.count(F.lit(1)).alias("n"), F.count_if("flag").alias("flagged"))


@query("q61", "select chan, y, x, round(avg(value) over (partition by y, x order by chan rows between current row and 1 following), 6)+0.0e0 as value from fx_image")
def channel_smoothing(v):
    return spectra.smoothed_channels(v("fx_image")).select("chan", "y", "x", r("value", 6).alias("value"))


@query("q65", f"select y, x, round({TAPER.format(c='y').replace('i.', '')}*{TAPER.format(c='x').replace('i.', '')}, 10)+0.0e0 as value from fx_image where chan = 0")
def apodize(v):
    return v("fx_image").where("chan = 0").select("y", "x", r(im.taper(8, 8, 0.6), 10).alias("value"))


_SG = "(3.0e0/(2.0e0*sqrt(2.0e0*ln(2.0e0))))"


@query("q66", f"select y, x, round(g/sum(g) over (), 10) as beam, round(exp(-2.0e0*pi()*pi()*{_SG}*{_SG}*(ky*ky+kx*kx)/64.0e0), 10) as transfer from (select y, x, exp(-0.5e0*((y-4)*(y-4)+(x-4)*(x-4))/({_SG}*{_SG})) as g, case when y>=4 then y-8 else y end as ky, case when x>=4 then x-8 else x end as kx from fx_image where chan=0) t")
def gaussian_beam(v):
    g = im.gaussian_beam(v("fx_image").sparkSession, 8, 8, 3.0)
    return g.select("y", "x", F.round("value", 10).alias("beam"), F.round(im.transfer(8, 8, 3.0), 10).alias("transfer"))


def _tf(fwhm: str) -> str:
    s = f"({fwhm}/(2.0e0*sqrt(2.0e0*ln(2.0e0))))"
    return f"exp(-2.0e0*pi()*pi()*{s}*{s}*(ky*ky+kx*kx)/64.0e0)"


@query("q67", f"with a as ({dft_sql('(select * from fx_image where chan=0)', chan='')}), b as ({dft_sql('(select * from fx_image where chan=1)', chan='')}), t as (select y, x, case when x=0 and y=0 then 1.0e0 else s*s/(s*s+g*g+1.0e-12) end as t from (select y, x, {_tf('4.0e0')} as s, {_tf('2.0e0')} as g from (select y, x, case when y>=4 then y-8 else y end as ky, case when x>=4 then x-8 else x end as kx from fx_image where chan=0) k) w), m as (select b.y, b.x, b.re+t.t*(a.re-b.re) as re, b.im+t.t*(a.im-b.im) as im from a join b on a.y=b.y and a.x=b.x join t on t.y=a.y and t.x=a.x) select f.y, f.x, round(sum(m.re*cos(2.0e0*pi()*((f.y*m.y+f.x*m.x) % 8)/8.0e0)-m.im*sin(2.0e0*pi()*((f.y*m.y+f.x*m.x) % 8)/8.0e0))/64.0e0, 6)+0.0e0 as value from m cross join (select y, x from fx_image where chan=0) f group by f.y, f.x")
def feather(v):
    image = v("fx_image")
    t = im.feather(image.where("chan = 0"), image.where("chan = 1").withColumn("chan", F.lit(0)), 8, 8, 4.0, 2.0, im.dft)
    return t.select("y", "x", r("value", 6).alias("value"))


@query("q68", "select y, x, round(2.0e0*(0.5e0*x+1.25e0)/7.0e0-1.0e0, 8)+0.0e0 as gx, round(2.0e0*(0.5e0*y+0.75e0)/7.0e0-1.0e0, 8)+0.0e0 as gy from fx_image where chan=0")
def sampling_grid(v):
    from ..functions import sky

    inside = {"CRVAL1": 80.0, "CRVAL2": 0.0, "CRPIX1": 4.5, "CRPIX2": 4.5, "CDELT1": -1e-4, "CDELT2": 1e-4}
    # a target of half the pixel size: pixel p of it lies at 0.5 p + shift of the input, to the projection's accuracy
    target = inside | {"CRPIX1": 5.5, "CRPIX2": 6.5, "CDELT1": -5e-5, "CDELT2": 5e-5}
    ra, dec = sky.to_sky(F.col("x").cast("double"), F.col("y").cast("double"), target)
    px, py = sky.to_pixel(ra, dec, inside)
    t = v("fx_image").where("chan = 0")
    return t.select("y", "x", r(2 * px / 7 - 1, 8).alias("gx"), r(2 * py / 7 - 1, 8).alias("gy"))


@query("q69", "select chan, y//2 as y, x//2 as x, round(avg(value), 6)+0.0e0 as value from fx_image group by chan, y//2, x//2")
def downsampled(v):
    return im.halved(v("fx_image"), 2).select("chan", "y", "x", r("value", 6).alias("value"))


@query("q70", "select cast(g//12 as int) as y, cast(g%12 as int) as x, round(coalesce(value, 0.0e0), 6)+0.0e0 as value from (select unnest(range(0, 144)) as g) s left join fx_image i on i.chan = 0 and i.y + 2 = g//12 and i.x + 2 = g%12")
def padded(v):
    return im.padded(v("fx_image").where("chan = 0"), 8, 8, 0.5).select("y", "x", r("value", 6).alias("value"))


_EA, _EB = "(30.0e0/2.3548e0/7.0e0)", "(15.0e0/2.3548e0/7.0e0)"


@query("q71", f"select y, x, round(2.0e0*g/(sum(g) over ()*49.0e0), 9) as value from (select y, x, exp(-0.5e0*(pow(((x-4)*cos(radians(30.0e0))+(y-4)*sin(radians(30.0e0)))/{_EA},2.0e0)+pow(((y-4)*cos(radians(30.0e0))-(x-4)*sin(radians(30.0e0)))/{_EB},2.0e0))) as g from fx_image where chan=0) t")
def elliptical_source(v):
    return im.elliptical_source(v("fx_image").sparkSession, 8, 8, 7.0, 2.0, 30.0, 15.0, 30.0).select("y", "x", F.round("value", 9).alias("value"))


@query("q72", "select chan, round(m, 6) as flux, round(mx/m, 6) as cx, round(my/m, 6) as cy, round(xx/m-mx/m*mx/m, 6) as sxx, round(yy/m-my/m*my/m, 6) as syy, round(xy/m-mx/m*my/m, 6)+0.0e0 as sxy from (select chan, sum(w) as m, sum(w*x) as mx, sum(w*y) as my, sum(w*x*x) as xx, sum(w*y*y) as yy, sum(w*x*y) as xy from (select chan, y, x, greatest(value, 0.0e0) as w from fx_image) t group by chan) s")
def moments(v):
    t = im.moments(v("fx_image"))
    return t.select("chan", *[F.round(c, 6).alias(c) for c in ("flux", "cx", "cy", "sxx", "syy")], r("sxy", 6).alias("sxy"))


_COEF = "(select chan as k, y, x, value from fx_image where chan < 3)"


@query("q73", f"select b.chan, c.y, c.x, round(sum(c.value*b.value), 6)+0.0e0 as value, round(sum(case when c.k < 2 then c.value*b.value else 0.0e0 end), 6)+0.0e0 as line from {_COEF} c join fx_basis b on b.k = c.k where b.chan < 7 group by b.chan, c.y, c.x")
def low_rank_cube(v):
    coef, basis = v("fx_image").where("chan < 3").withColumnRenamed("chan", "k"), v("fx_basis").where("chan < 7")
    line, _ = spectral.line_and_continuum(coef, basis, 2)
    t = spectral.cube(coef, basis).join(line.withColumnRenamed("value", "line"), ["chan", "y", "x"])
    return t.select("chan", "y", "x", r("value", 6).alias("value"), r("line", 6).alias("line"))


@query("q75", "select cast(k as int) as k, chan, round(case when k < 2 and chan in (0, 6) then 0.0e0 else 1000.0e0*value end, 8)+0.0e0 as value from (select g + 2 as k, chan, case when g = 0 then 1.0e0 else pow((frequency-1.42e9)/1.42e9, cast(g as double)) end as value from fx_channel cross join (select unnest(range(0, 3)) as g) s union all select b.k, b.chan, b.value from fx_basis b where b.k < 2 and b.chan < 7) t")
def continuum_basis(v):
    cont = spectral.continuum_basis(v("fx_channel"), 2, 1.42e9, first_k=2)
    both = cont.unionByName(v("fx_basis").where("k < 2 and chan < 7"))
    t = spectral.continuum_only(both, [0, 6], 2)
    return t.select(F.col("k").cast("int").alias("k"), "chan", r(1000 * F.col("value"), 8).alias("value"))


@query("q76", "with h as (select cast(k as int) as k, cast(c as int) as chan, case when k = 0 then 0 else cast(floor(ln(k)/ln(2)+1.0e-9) as int) end as l from (select unnest(range(0, 8)) as k) a cross join (select unnest(range(0, 8)) as c) b) select k, chan, round(case when k = 0 then 1.0e0/sqrt(8.0e0) when p >= 0 and p < w/2 then 1.0e0/sqrt(w) when p >= w/2 and p < w then -1.0e0/sqrt(w) else 0.0e0 end, 8)+0.0e0 as value, round(exp(-0.5e0*pow((chan-k)/1.5e0, 2.0e0)), 8) as gauss from (select k, chan, 8.0e0/pow(2.0e0, l) as w, chan-(k-pow(2.0e0, l))*(8.0e0/pow(2.0e0, l)) as p from h) t")
def haar_basis(v):
    spark = v("fx_channel").sparkSession
    grid = spark.range(64).select(F.floor(F.col("id") / 8).cast("int").alias("k"), (F.col("id") % 8).cast("int").alias("chan"))
    atoms = spectral.gaussian_dictionary(spark.range(8).select(F.col("id").cast("int").alias("chan")), list(range(8)), [1.5]).withColumnRenamed("value", "gauss")
    return grid.join(atoms, ["k", "chan"]).select("k", "chan", r(spectral.haar(F.col("k"), F.col("chan"), 8), 8).alias("value"), F.round("gauss", 8).alias("gauss"))


@query("q78", "with f as (select beam, block, regr_slope(re, chan) as s, regr_intercept(re, chan) as i from fx_sky where chan in (0, 1, 5, 6) group by beam, block) select v.beam, v.chan, round(avg(re-(s*chan+i)), 6)+0.0e0 as line_re from fx_sky v join f on v.beam = f.beam and v.block = f.block group by v.beam, v.chan")
def continuum_subtraction(v):
    t = spectral.subtract_continuum(v("fx_sky"), [0, 1, 5, 6], ["beam", "block"])
    return t.groupBy("beam", "chan").agg(r(F.avg("line_re"), 6).alias("line_re"))
