"""Work of a survey's size: images that grow with the tables, solvers of several iterations, models, and what came with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest, spectra, spectral
from ..operators import measure as me
from .imaging import _RES, _RHS, CELL, INTERP, _good, adjoint_sql, forward_sql, vis_sql
from .registry import query, r

FIELD_WIDTH = 100
#: With this many cells a sample, gridding errs by rounding alone, so digits can be compared.
SPREAD = 14
_HALF = "(select cast(ceil((max(y)+1)/2.0e0 - 0.5e0) as int) as h from fx_field)"
_AT = f"(v.ur*(i.x-{FIELD_WIDTH // 2})-v.vr*(i.y-h.h))"


def _keyed(where: str = "true") -> str:
    """``vis_sql`` on samples whose ids need no sort."""
    return vis_sql(where).replace("fx_stokes", "fx_keyed")


def _samples(v):
    return me.radpix(v("fx_keyed").where("not flag"), v("fx_channel"), CELL)


def field(v):
    """The growing image, its height and width."""
    image = v("fx_field")
    return image, image.agg(F.max("y")).first()[0] + 1, FIELD_WIDTH


@query("q40_field", f"with {_keyed('not flag')}, h as {_HALF} select v.vis_id, v.beam, v.chan, round(49.0e0*sum(i.value*cos{_AT}), 2)+0.0e0 as re, round(49.0e0*sum(i.value*sin{_AT}), 2)+0.0e0 as im from vis v cross join fx_field i cross join h group by v.vis_id, v.beam, v.chan")
def degrid_field(v):
    from ..operators import nufft

    image, h, w = field(v)
    t = nufft.forward(_samples(v), image, h, w, CELL, spread=SPREAD)
    return t.select("vis_id", "beam", "chan", r("m_re", 2).alias("re"), r("m_im", 2).alias("im"))


@query("q41_field", f"with {_keyed('not flag')}, h as {_HALF}, p as (select y, x from fx_field) select v.beam, v.chan, i.y, i.x, round(49.0e0*sum(v.re*cos{_AT}+v.im*sin{_AT}), 3)+0.0e0 as re, round(49.0e0*sum(v.im*cos{_AT}-v.re*sin{_AT}), 3)+0.0e0 as im from vis v cross join p i cross join h group by v.beam, v.chan, i.y, i.x")
def dirty_field(v):
    from ..operators import nufft

    image, h, w = field(v)
    t = nufft.adjoint(_samples(v), h, w, CELL, spread=SPREAD, pixels=image)
    return t.select("beam", "chan", "y", "x", r("re", 3).alias("re"), r("im", 3).alias("im"))


@query("q74_field", f"with {_keyed('not flag')}, h as {_HALF}, d as (select v.vis_id, k.k, 49.0e0*sum(i.value*(1.0e0+k.k*i.x)*cos{_AT}) as re, 49.0e0*sum(i.value*(1.0e0+k.k*i.x)*sin{_AT}) as im from vis v cross join fx_field i cross join h cross join (select distinct k from fx_basis) k group by v.vis_id, k.k) select vis_id, b.chan, round(sum(d.re*b.value), 0)+0.0e0 as re, round(sum(d.im*b.value), 0)+0.0e0 as im from d join fx_basis b on b.k = d.k join fx_channel c on c.chan = b.chan group by vis_id, b.chan")
def channel_invariant_field(v):
    """Three maps of the field and every channel at all samples."""
    image, h, w = field(v)
    basis = v("fx_basis").join(v("fx_channel").select("chan"), "chan")
    coef = image.crossJoin(F.broadcast(basis.select("k").distinct())).select("k", "y", "x", (F.col("value") * (1 + F.col("k") * F.col("x"))).alias("value"))
    t = spectral.mixed_visibilities(_samples(v), coef, basis, h, w, CELL, "nufft", SPREAD)
    return t.select("vis_id", "chan", r("re", 0).alias("re"), r("im", 0).alias("im"))


_BINS = "b as (select beam, chan, min(wl) as lo, max(wl) as hi from vis group by beam, chan), w as (select v.*, lo + (least(cast(floor((wl-lo)/((hi-lo)/5.0e0)) as int), 4)+0.5e0)*((hi-lo)/5.0e0) as wc from vis v join b on b.beam = v.beam and b.chan = v.chan)"


@query("q77_field", f"with {_keyed('not flag')}, {_BINS}, h as {_HALF}, i as (select y, x, value, ((y-h)*(y-h)+(x-{FIELD_WIDTH // 2})*(x-{FIELD_WIDTH // 2}))*pow(7.0e0*pi()/648000.0e0, 2.0e0) as r2, h from fx_field cross join h), h2 as (select * from h) select vis_id, v.beam, v.chan, round(49.0e0*sum(i.value*cos({_AT.replace('h.h', 'i.h')}+v.wc*pi()*r2)), 2)+0.0e0 as re, round(49.0e0*sum(i.value*sin({_AT.replace('h.h', 'i.h')}+v.wc*pi()*r2)), 2)+0.0e0 as im from w v cross join i group by vis_id, v.beam, v.chan")
def w_planes_field(v):
    image, h, w = field(v)
    channels = image.crossJoin(F.broadcast(v("fx_channel").select("chan")))  # one sky for the seven channels
    t = spectral.w_stacked(_samples(v), channels, h, w, CELL, 5, ("beam", "chan"), "nufft", SPREAD)
    return t.select("vis_id", "beam", "chan", r("m_re", 2).alias("re"), r("m_im", 2).alias("im"))


@query("q77_planes", f"with {vis_sql('not flag')}, {_BINS} select vis_id, v.beam, v.chan, round(49.0e0*sum(i.value*cos((v.ur*(i.x-4)-v.vr*(i.y-4))+v.wc*pi()*r2)), 5)+0.0e0 as re, round(49.0e0*sum(i.value*sin((v.ur*(i.x-4)-v.vr*(i.y-4))+v.wc*pi()*r2)), 5)+0.0e0 as im from w v join (select chan, y, x, value, ((y-4)*(y-4)+(x-4)*(x-4))*pow(7.0e0*pi()/648000.0e0, 2.0e0) as r2 from fx_image) i on i.chan = v.chan group by vis_id, v.beam, v.chan")
def w_planes(v):
    """q77_all's rows by one gridded transform a bin."""
    t = spectral.w_stacked(_good(v), v("fx_image"), 8, 8, CELL, 5, ("beam", "chan"), "nufft", SPREAD)
    return t.select("vis_id", "beam", "chan", r("m_re", 5).alias("re"), r("m_im", 5).alias("im"))


# ---------------------------------------------------------------- solvers and models


def _unsorted(v):
    """The operator for an objective, which writes good samples once: their ids need no order."""
    vis = v("fx_sky").withColumn("vis_id", F.monotonically_increasing_id())
    return me.Measurement(vis, v("fx_channel"), v("fx_pb"), v("fx_grid"), 8, 8, CELL)


def _cg_sql(iterations: int) -> str:
    """The conjugate-gradient iterates from zero, written out: x, r, p and their scalars, one after the other."""
    m = "as materialized"
    out = f"with {vis_sql()}, {INTERP}, {_RHS}, {adjoint_sql('rhs_s', 'b')}, x0 {m} (select chan, y, x, 0.0e0 as v, re as r, re as p from b)"
    for i in range(iterations):
        out += f""", p{i} {m} (select chan, y, x, p as value from x{i}), {forward_sql(f'p{i}', f'm{i}')},
 ns{i} as (select v.chan, v.beam, v.ur, v.vr, m_re/(sigma*sigma) as re, m_im/(sigma*sigma) as im from vis v join m{i} m on m.vis_id = v.vis_id), {adjoint_sql(f'ns{i}', f'n{i}')},
 q{i} {m} (select s.chan, s.y, s.x, s.v, s.r, s.p, n.re as ap from x{i} s join n{i} n on n.chan = s.chan and n.y = s.y and n.x = s.x),
 a{i} {m} (select sum(r*r)/sum(p*ap) as a, sum(r*r) as rr from q{i}), y{i} {m} (select chan, y, x, v + a*p as v, r - a*ap as r, p from q{i} cross join a{i}),
 c{i} {m} (select sum(r*r) as rr from y{i}), x{i + 1} {m} (select chan, y, x, v, r, r + c{i}.rr/a{i}.rr*p as p from y{i} cross join c{i} cross join a{i})"""
    return out + f" select chan, y, x, round(1000.0e0*v, 4)+0.0e0 as value from x{iterations}"


@query("q83_solver", _cg_sql(3))
def conjugate_gradient(v):
    """Three iterations over the whole cube, the state written as tables between them."""
    from ..plans import iterative, models

    channels = [row["chan"] for row in v("fx_channel").select("chan").collect()]
    obj = models.Objective(_unsorted(v), models.Cube(channels))
    t = iterative.conjugate_gradient(obj, iterations=3)
    return t.select("chan", "y", "x", r(1000 * F.col("value"), 4).alias("value"))


_COEF = "coef as (select chan as k, y, x, value from fx_image where chan < 3), basis as (select b.k, b.chan, b.value from fx_basis b join fx_channel c on c.chan = b.chan where b.k < 2 union all select 2, chan, 1.0e0 from fx_channel), cube as (select b.chan, a.y, a.x, sum(a.value*b.value) as value from coef a join basis b on b.k = a.k group by b.chan, a.y, a.x)"


@query("q88_low_rank", f"with {vis_sql()}, {INTERP}, {_COEF}, {forward_sql('cube', 'm')}, {_RES}, {adjoint_sql('res', 'a')}, g as (select a.chan, a.y, a.x, a.re - 2.0e0*0.3e0*greatest(-c.value, 0.0e0) as g from a join cube c on c.chan = a.chan and c.y = a.y and c.x = a.x) select cast(b.k as int) as k, y, x, round(sum(g*b.value), 1)+0.0e0 as gradient from g join basis b on b.chan = g.chan group by b.k, y, x")
def low_rank_gradient(v):
    """The gradient of two line spectra and a flat continuum, with negative cube values penalised."""
    from ..plans import models

    lines = v("fx_basis").where("k < 2").join(v("fx_channel").select("chan"), "chan").select("k", "chan", "value")
    obj = models.Objective(_unsorted(v), models.with_continuum(lines, v("fx_channel")), [models.Negativity(0.3)])
    start = v("fx_image").where("chan < 3").select(F.col("chan").alias("k"), "y", "x", "value")
    return obj.evaluate(start, False).table.select("k", "y", "x", r("gradient", 1).alias("gradient"))


_MIXTURE = "p as (select c.chan, f.y, f.x, 1.0e0 + f.value as a, 3.0e0 + 0.1e0*f.x as mu, 1.0e0 + 0.2e0*f.y as s from fx_image f cross join fx_channel c where f.chan = 0)"


@query("q89_mixture", f"with {vis_sql()}, {INTERP}, {_MIXTURE}, cube as (select chan, y, x, a*exp(-0.5e0*pow((chan - mu)/s, 2.0e0)) as value from p), {forward_sql('cube', 'm')}, {_RES}, {adjoint_sql('res', 'g')}, d as (select p.y, p.x, sum(g.re*exp(-0.5e0*pow((p.chan - mu)/s, 2.0e0))) as d0, sum(g.re*a*exp(-0.5e0*pow((p.chan - mu)/s, 2.0e0))*(p.chan - mu)/(s*s)) as d1, sum(g.re*a*exp(-0.5e0*pow((p.chan - mu)/s, 2.0e0))*pow(p.chan - mu, 2.0e0)/(s*s*s)) as d2 from g join p on p.chan = g.chan and p.y = g.y and p.x = g.x group by p.y, p.x) select 0 as k, y, x, round(d0, 1)+0.0e0 as gradient from d union all select 1, y, x, round(d1, 1)+0.0e0 from d union all select 2, y, x, round(d2, 1)+0.0e0 from d")
def mixture_gradient(v):
    """The gradient of a free Gaussian a pixel by its height, centre and width."""
    from ..plans import models

    obj = models.Objective(_unsorted(v), models.GaussianMixture(v("fx_channel"), 1))
    plane = v("fx_image").where("chan = 0")
    maps = [(0, 1.0 + F.col("value")), (1, 3.0 + 0.1 * F.col("x")), (2, 1.0 + 0.2 * F.col("y"))]
    start = plane.select("y", "x", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), c.alias("value")) for k, c in maps]))).select("k", "y", "x", "value")
    return obj.evaluate(start, False).table.select("k", "y", "x", r("gradient", 1).alias("gradient"))


@query("q90_power_law", "select c.chan, f.y, f.x, round(f.value*pow(c.frequency/1.42e9, -(1.0e0 + 0.01e0*f.x)), 6)+0.0e0 as value from fx_field f cross join fx_channel c")
def power_law(v):
    image, _, _ = field(v)
    alpha = image.select("y", "x", (1.0 + 0.01 * F.col("x")).alias("value"))
    return spectral.power_law(image, alpha, v("fx_channel"), 1.42e9).select("chan", "y", "x", r("value", 6).alias("value"))


@query("q76_principal", "select a.chan as c, b.chan as d, round(covar_samp(a.value, b.value), 6)+0.0e0 as cov from fx_cube a join fx_cube b on b.y = a.y and b.x = a.x group by a.chan, b.chan")
def principal_spectra(v):
    """The covariance of the channels, put together again from all principal spectra and their variances."""
    basis, _, variance = spectral.principal_basis(v("fx_cube"), 7)
    t = basis.join(variance, "k")
    other = basis.select("k", F.col("chan").alias("d"), F.col("value").alias("w"))
    cov = F.sum(F.col("variance") * F.col("value") * F.col("w"))
    return t.join(other, "k").groupBy(F.col("chan").alias("c"), "d").agg(r(cov, 6).alias("cov"))


@query("q76_reconstructed", "select chan, y, x, round(value, 6)+0.0e0 as value from fx_cube")
def reconstructed(v):
    """The cube from its mean spectrum and the maps of all principal spectra."""
    cube = v("fx_cube")
    basis, mean, _ = spectral.principal_basis(cube, 7)
    back = spectral.cube(spectral.coefficients(cube, basis, mean), basis).join(mean.select("chan", F.col("value").alias("mean")), "chan")
    return back.select("chan", "y", "x", r(F.col("value") + F.col("mean"), 6).alias("value"))


# ---------------------------------------------------------------- spectra, channels, cubes


@query("q54_all", "select chan, round(quantile_cont(p1_re, 0.05), 6)+0.0e0 as lo, round(quantile_cont(p1_re, 0.997), 6)+0.0e0 as hi from fx_plain group by chan")
def limits_of_all(v):
    """Percentiles of every sample of a channel, by passes of histograms."""
    t = spectra.percentiles(v("fx_plain").select("chan", F.col("p1_re").alias("value")), 0.05, 0.997)
    return t.select("chan", r("lo", 6).alias("lo"), r("hi", 6).alias("hi"))


_EDGES = "e as (select chan, frequency - 0.5e6 as f0, frequency + 0.5e6 as f1 from fx_channel), v as (select chan, (1.42040575177e9 - f1)/1.42040575177e9*299792.458e0 as v0, (1.42040575177e9 - f0)/1.42040575177e9*299792.458e0 as v1 from e), n as (select unnest(range(0, 10)) as i), o as (select chan, cast(i as int) as i, least(v1, -700.0e0 + i*150.0e0 + 75.0e0) - greatest(v0, -700.0e0 + i*150.0e0 - 75.0e0) as w from v cross join n)"


@query("q86_regrid", f"with {_EDGES}, g as (select beam, ant1, ant2, chan, avg(re) as re, avg(im) as im, sqrt(sum(sigma*sigma))/count(*) as sigma from fx_sky where not flag group by beam, ant1, ant2, chan) select beam, ant1, ant2, i as chan, -700.0e0 + i*150.0e0 as velocity, round(sum(w)/150.0e0, 6) as coverage, round(sum(re*w)/sum(w) + 1.0e-9, 6)+0.0e0 as re, round(sum(im*w)/sum(w) + 1.0e-9, 6)+0.0e0 as im, round(sqrt(sum(sigma*sigma*w*w))/sum(w) + 1.0e-9, 6) as sigma from g join o on o.chan = g.chan where w > 0 group by beam, ant1, ant2, i")
def regrid(v):
    """All baselines' spectra on ten velocity channels of 150 km/s."""
    t = spectral.regrid(v("fx_sky"), v("fx_channel"), 10, -700.0, 150.0, ["beam", "ant1", "ant2"], ["re", "im"])
    return t.select("beam", "ant1", "ant2", "chan", "velocity", F.round("coverage", 6).alias("coverage"), r(F.col("re") + 1e-9, 6).alias("re"), r(F.col("im") + 1e-9, 6).alias("im"), F.round(F.col("sigma") + 1e-9, 6).alias("sigma"))


@query("q87_merge_cubes", "with d as (select block, chan, ant1 as y, ant2 as x, avg(re) as value from fx_sky group by block, chan, ant1, ant2), n as (select block, sum(n) over (order by block rows between unbounded preceding and 1 preceding) as before from (select block, max(chan) + 1 as n from d group by block)) select cast(d.chan + coalesce(before, 0) as int) as chan, y, x, round(value + 1.0e-9, 6)+0.0e0 as value from d join n using (block)")
def merged_cubes(v):
    """The blocks' cubes one behind the other on the channel axis."""
    planes = v("fx_sky").groupBy("block", "chan", F.col("ant1").alias("y"), F.col("ant2").alias("x")).agg(F.avg("re").alias("value")).withColumnRenamed("block", "cube")
    size = planes.groupBy("cube").agg((F.max("chan") + 1).cast("long").alias("n"))
    lowest = size.agg(F.min("cube")).first()[0] or 0
    # a survey's cubes say where they begin; here each begins where the one before ends
    cubes = size.select("cube", ((F.col("cube") - lowest) * F.col("n")).alias("first"), "n")
    return ingest.merge_cubes(planes, cubes).select("chan", "y", "x", r(F.col("value") + 1e-9, 6).alias("value"))


_GREY = "(0.299e0*red + 0.587e0*green + 0.114e0*blue)"


@query("q20_saturated", "with c as (select y, x, value/5.0e0 as red, value/6.0e0 as green, value*value/9.0e0 as blue from fx_field) select y, x, " + ", ".join(f"round(least(greatest({_GREY} + ({c} - {_GREY})*1.4e0, 0.0e0), 1.0e0), 6)+0.0e0 as {c}" for c in ("red", "green", "blue")) + " from c")
def saturated(v):
    from ..functions import display

    value = F.col("value")
    shown = display.saturate(value / 5.0, value / 6.0, value * value / 9.0, 1.4)
    return v("fx_field").select("y", "x", *[r(c, 6).alias(n) for c, n in zip(shown, ("red", "green", "blue"))])


@query("q44_nan", "select beam, chan, round(0.5e0*sum(case when re > 2.0e0 then 0.0e0 else (re*re+im*im)/(sigma*sigma) end), 4) as chi2 from fx_sky where not flag group by beam, chan")
def chi2_without_nan(v):
    """χ² where samples above a level are NaN: these add nothing."""
    from ..operators import objective

    t = v("fx_sky").withColumn("re", F.when(F.col("re") > 2.0, F.lit(float("nan"))).otherwise(F.col("re")))
    return objective.chi2_ignoring_nan(t).select("beam", "chan", F.round("chi2", 4).alias("chi2"))



# ---------------------------------------------------------------- lists, names and cells


@query("q23_ranges", "select beam, cast(coalesce(sum(n) over (order by beam rows between unbounded preceding and 1 preceding), 0) as bigint) as first, n from (select beam, count(*) as n from fx_sky group by beam) t")
def beam_ranges(v):
    return ingest.beam_ranges(v("fx_sky"))


@query("q31_offsets", "select block, nbeam, cast(coalesce(sum(nbeam) over (order by block rows between unbounded preceding and 1 preceding), 0) as bigint) as offset_ from (select block, max(beam) + 1 as nbeam from fx_sky group by block) t")
def beam_offsets(v):
    return ingest.beam_offsets(v("fx_sky")).select("block", "nbeam", F.col("offset").alias("offset_"))


@query("q34_channels", "select chan from fx_channel where abs(l - frequency) > 1.0e-6".replace("from fx_channel", "from (select chan, frequency, frequency + (case when chan % 3 = 2 then 1.0e-3 else 1.0e-7 end) as l from fx_channel) t"))
def moved_channels(v):
    """Channels whose frequencies differ by more than the tolerance."""
    axis = v("fx_channel")
    return ingest.mismatched_channels(axis, axis.withColumn("frequency", F.col("frequency") + F.when(F.col("chan") % 3 == 2, 1e-3).otherwise(1e-7)))


@query("q36_paired", "select a.block, b.chan from (select block, row_number() over (order by block) as k from (select distinct block from fx_sky) x) a join (select chan, row_number() over (order by chan) as k from fx_channel) b using (k)")
def paired(v):
    return ingest.paired(v("fx_sky").select("block").distinct(), v("fx_channel").select("chan"), "block", "chan").select("block", "chan")


_NAME = "concat('MS_M', cast(s_suppkey + 10 as varchar(20)), '-09', case when s_suppkey % 3 = 0 then 'A' when s_suppkey % 3 = 1 then 'B' else 'C' end, '_x_MS_M', cast(s_suppkey as varchar(20)), '+61', case when s_suppkey % 2 = 0 then 'C' else 'A' end, '_beam', cast(s_suppkey % 36 as varchar(20)), '.ms')"


@query("q02_leaves", f"select {_NAME} as name, case when s_suppkey % 2 = 0 then 'C' else 'A' end as leave, cast(s_suppkey % 36 as int) as beam, concat('ASKAP_BEAM', lpad(cast(s_suppkey % 36 as varchar(20)), 2, '0'), '.fits') as file from supplier")
def leaves(v):
    return ingest.beam_files(v("supplier").select(F.expr(_NAME).alias("name")))


@query("q23_cells", "select block, chan, beam, count(*) as n, round(sum(1.0e0/(sigma*sigma)), 4) as weight from fx_sky where not flag group by block, chan, beam")
def cells(v):
    """The stream of cells, each summed by itself."""
    from ..plans import imager

    def work(key, pdf):
        import pandas as pd

        return pd.DataFrame({"block": [key[0]], "chan": [key[1]], "beam": [key[2]], "n": [len(pdf)], "weight": [(1 / pdf.sigma**2).sum()]})

    t = imager.by_cell(v("fx_sky").where("not flag").select("block", "chan", "beam", "sigma"), work, "block int, chan int, beam int, n long, weight double")
    return t.select("block", "chan", "beam", "n", F.round("weight", 4).alias("weight"))


@query("q68_field", f"select y, x, round(2.0e0*(0.5e0*x+1.25e0)/({FIELD_WIDTH}-1)-1.0e0, 7)+0.0e0 as gx, round(2.0e0*(0.5e0*y+0.75e0)/(h-1)-1.0e0, 7)+0.0e0 as gy from fx_field cross join (select max(y)+1 as h from fx_field) t")
def sampling_grid_field(v):
    """Where each pixel of a target of half the pixel size lies in the field's own frame."""
    from ..operators import measure

    image, h, w = field(v)
    own = {"CRVAL1": 80.0, "CRVAL2": 0.0, "CRPIX1": 4.5, "CRPIX2": 4.5, "CDELT1": -1e-6, "CDELT2": 1e-6, "NAXIS1": w, "NAXIS2": h}
    target = own | {"CRPIX1": 5.5, "CRPIX2": 6.5, "CDELT1": -5e-7, "CDELT2": 5e-7}
    t = measure.sampling_grid(image.select("y", "x"), target, own)
    return t.select("y", "x", r("gx", 7).alias("gx"), r("gy", 7).alias("gy"))


@query("q69_thirds", "select cast(floor(y/3) as int) as y, cast(floor(x/3) as int) as x, round(value, 6)+0.0e0 as value from fx_field cross join (select max(y)+1 as h from fx_field) t where y % 3 = 1 and x % 3 = 1 and y < 3*floor(h/3) and x < 99")
def thirds(v):
    from ..operators import images

    image, h, w = field(v)
    return images.halved(image.withColumn("chan", F.lit(0)), 3, h, w).select("y", "x", r("value", 6).alias("value"))
