"""Measurement operator, objective, gradient and solver steps (q40-q47, q62-q64, q74, q77, q83, q84)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import images as im
from ..operators import measure as me
from ..operators import nufft
from ..operators import objective as ob
from .registry import query, r

CELL = 7.0
_C = "299792458.0e0"


def vis_sql(where: str = "true") -> str:
    rad = lambda c: f"{c}*(frequency/{_C})*(2.0e0*pi())*(7.0e0*(pi()/648000.0e0))"
    return f"vis as (select vis_id, s.chan, beam, re, im, sigma, flag, {rad('uu')} as ur, {rad('vv')} as vr, ww*(frequency/{_C}) as wl from fx_stokes s join fx_channel c on s.chan = c.chan where {where})"


INTERP = """interp as (select beam, y as y_out, x as x_out, y0+dy as y_in, x0+dx as x_in, (case when dx=1 then fx else 1.0e0-fx end)*(case when dy=1 then fy else 1.0e0-fy end) as w
 from (select beam, y, x, cast(floor(px) as int) as x0, cast(floor(py) as int) as y0, px-floor(px) as fx, py-floor(py) as fy from (select beam, y, x, 0.5e0*(gx+1)*7 as px, 0.5e0*(gy+1)*7 as py from fx_grid) q) t
 cross join (values (0,0),(1,0),(0,1),(1,1)) d(dx,dy) where y0+dy between 0 and 7 and x0+dx between 0 and 7)"""
PHASE = "(v.ur*(i.x-4)-v.vr*(i.y-4))"


def forward_sql(image: str, out: str) -> str:
    """CTEs: ``out`` = A image (chan, y, x, value) at the samples of ``vis`` that aren't flagged."""
    return f"""{out}_b as (select w.beam, i.chan, w.y_out as y, w.x_out as x, sum(w.w*i.value*p.value) as value from interp w join {image} i on i.y = w.y_in and i.x = w.x_in join fx_pb p on p.beam = w.beam and p.y = w.y_out and p.x = w.x_out group by w.beam, i.chan, w.y_out, w.x_out),
{out} as (select v.vis_id, 49.0e0*sum(i.value*cos({PHASE})) as m_re, 49.0e0*sum(i.value*sin({PHASE})) as m_im from vis v join {out}_b i on i.beam = v.beam and i.chan = v.chan where not v.flag group by v.vis_id)"""


def adjoint_sql(samples: str, out: str) -> str:
    """CTEs: ``out`` = Aᴴ of samples (chan, beam, ur, vr, re, im): (chan, y, x, re, im)."""
    return f"""{out}_d as (select v.chan, v.beam, i.y, i.x, 49.0e0*sum(v.re*cos({PHASE})+v.im*sin({PHASE})) as re, 49.0e0*sum(v.im*cos({PHASE})-v.re*sin({PHASE})) as im from {samples} v cross join (select y, x from fx_image where chan=0) i group by v.chan, v.beam, i.y, i.x),
{out} as (select z.chan, w.y_in as y, w.x_in as x, sum(w.w*p.value*z.re) as re, sum(w.w*p.value*z.im) as im from {out}_d z join fx_pb p on p.beam = z.beam and p.y = z.y and p.x = z.x join interp w on w.beam = z.beam and w.y_out = z.y and w.x_out = z.x group by z.chan, w.y_in, w.x_in)"""


def operator(v, where: str = "true") -> me.Measurement:
    return me.Measurement(v("fx_stokes").where(where), v("fx_channel"), v("fx_pb"), v("fx_grid"), 8, 8, CELL)


@query("q40", f"with {vis_sql('beam=0 and s.chan=0 and not flag')} select vis_id, round(49.0e0*sum(i.value*cos({PHASE})), 6)+0.0e0 as re, round(49.0e0*sum(i.value*sin({PHASE})), 6)+0.0e0 as im from vis v cross join (select y, x, value from fx_image where chan=0) i group by vis_id")
def degrid(v):
    vis = me.radpix(v("fx_stokes").where("beam = 0 and chan = 0 and not flag"), v("fx_channel"), CELL)
    t = me.degrid(vis, v("fx_image").where("chan = 0").drop("chan"), 8, 8, CELL)
    return t.select("vis_id", r("m_re", 6).alias("re"), r("m_im", 6).alias("im"))


@query("q41", f"with {vis_sql('beam=0 and s.chan=0 and not flag')} select i.y, i.x, round(49.0e0*sum(v.re*cos({PHASE})+v.im*sin({PHASE})), 3)+0.0e0 as re, round(49.0e0*sum(v.im*cos({PHASE})-v.re*sin({PHASE})), 3)+0.0e0 as im from vis v cross join (select y, x from fx_image where chan=0) i group by i.y, i.x")
def dirty_image(v):
    vis = me.radpix(v("fx_stokes").where("beam = 0 and chan = 0 and not flag"), v("fx_channel"), CELL)
    t = me.grid_adjoint(vis, v("fx_image").where("chan = 0"), 8, 8, CELL)
    return t.select("y", "x", r("re", 3).alias("re"), r("im", 3).alias("im"))


@query("q42", f"with {INTERP} select g.beam, g.y, g.x, round(coalesce(sum(w.w*i.value), 0.0e0)+1.0e-10, 6)+0.0e0 as value from fx_grid g left join interp w on w.beam = g.beam and w.y_out = g.y and w.x_out = g.x left join (select * from fx_image where chan=0) i on i.y = w.y_in and i.x = w.x_in group by g.beam, g.y, g.x")
def reprojection(v):
    grid = v("fx_grid")
    t = me.reproject(v("fx_image").where("chan = 0").drop("chan"), me.interp(grid, 8, 8), grid)
    return t.select("beam", "y", "x", r(F.col("value") + 1e-10, 6).alias("value"))


@query("q43", f"with {INTERP} select y_in as y, x_in as x, round(sum(w*p.value)+1.0e-10, 6)+0.0e0 as re, round(sum(w*i.value)+1.0e-10, 6)+0.0e0 as im from interp w join fx_pb p on p.beam = w.beam and p.y = w.y_out and p.x = w.x_out join (select * from fx_image where chan=0) i on i.y = w.y_out and i.x = w.x_out group by y_in, x_in")
def reprojection_adjoint(v):
    z = v("fx_pb").withColumnRenamed("value", "re").join(v("fx_image").where("chan = 0").select("y", "x", F.col("value").alias("im")), ["y", "x"])
    t = me.reproject_adjoint(z, me.interp(v("fx_grid"), 8, 8))
    return t.select("y", "x", r(F.col("re") + 1e-10, 6).alias("re"), r(F.col("im") + 1e-10, 6).alias("im"))


@query("q44", "select beam, chan, count(*) as n, round(0.5e0*sum((re*re+im*im)/(sigma*sigma)), 4) as chi2 from fx_sky where not flag and ant1 <> ant2 and sqrt(uu*uu+vv*vv+ww*ww) between 20.0e0 and 250.0e0 group by beam, chan")
def chi2(v):
    from ..operators import ingest

    t = ob.chi2(ingest.flag_uv_range(ingest.cross_only(v("fx_sky")), 20.0, 250.0))
    return t.select("beam", "chan", "n", F.round("chi2", 4).alias("chi2"))


TAPER = "(case when i.{c} >= 4 then cos((i.{c}-4)*(pi()/6.0e0)) else sin(i.{c}*(pi()/6.0e0)) end)"
_T = TAPER.format(c="y") + "*" + TAPER.format(c="x")


def dft_sql(source: str, value: str = "i.value", sign: str = "-", chan: str = "i.chan, ") -> str:
    a = "2.0e0*pi()*((f.y*i.y+f.x*i.x) % 8)/8.0e0"
    return f"select {chan}f.y, f.x, sum({value}*cos({a})) as re, {sign}sum({value}*sin({a})) as im from {source} i cross join (select y, x from fx_image where chan=0) f group by {chan}f.y, f.x"


_S = "(3.0e0/(2.0e0*sqrt(2.0e0*ln(2.0e0))))"
GAUSS = f"gauss as (select y, x, g/sum(g) over () as value from (select y, x, exp(-0.5e0*((y-4)*(y-4)+(x-4)*(x-4))/({_S}*{_S})) as g from fx_image where chan=0) t)"


@query("q45", f"with {GAUSS}, b as ({dft_sql('gauss', chan='')}), s as ({dft_sql('fx_image')}), m as ({dft_sql('fx_image', 'i.value*1.1e0*' + _T)}) select m.chan, round(0.5e0*2.0e-3*2401.0e0*sum(pow(m.re*sqrt(b.re*b.re+b.im*b.im)-s.re,2.0e0)+pow(m.im*sqrt(b.re*b.re+b.im*b.im)-s.im,2.0e0)), 4) as loss from m join b on b.y = m.y and b.x = m.x join s on s.chan = m.chan and s.y = m.y and s.x = m.x group by m.chan")
def single_dish_term(v):
    image = v("fx_image")
    t = ob.single_dish(image.withColumn("value", F.col("value") * 1.1), image, 8, 8, CELL, 3.0, 2e-3, radius=0.6)
    return t.select("chan", F.round("loss", 4).alias("loss"))


_LAP = "(select i.chan, i.y, i.x, i.v - 0.25e0*(a.v+b.v+c.v+d.v) as l from t i join t a on a.chan=i.chan and a.y=i.y and a.x=(i.x+1)%8 join t b on b.chan=i.chan and b.y=i.y and b.x=(i.x+7)%8 join t c on c.chan=i.chan and c.x=i.x and c.y=(i.y+1)%8 join t d on d.chan=i.chan and d.x=i.x and d.y=(i.y+7)%8)"


@query("q46", f"with t as (select i.chan, i.y, i.x, i.value*{_T} as v from fx_image i) select chan, round(0.5e0*1.0e-2*2401.0e0*64.0e0*sum(l*l), 4) as loss from {_LAP} z group by chan")
def laplacian_term(v):
    return ob.laplacian(v("fx_image"), 8, 8, CELL, 1e-2, radius=0.6).select("chan", F.round("loss", 4).alias("loss"))


@query("q47", "select chan, round(0.3e0*sum(pow(greatest(-value,0.0e0),2.0e0)), 6) as negative, round(0.5e0*0.3e0*sum(value*value), 6) as ridge from fx_image group by chan")
def penalties(v):
    a, b = ob.negativity(v("fx_image"), 0.3), ob.ridge(v("fx_image"), 0.3)
    return a.join(b.withColumnRenamed("loss", "ridge"), "chan").select("chan", F.round("loss", 6).alias("negative"), F.round("ridge", 6).alias("ridge"))


@query("q62", f"with {vis_sql('s.chan=0')}, {INTERP}, {forward_sql('fx_image', 'm')} select v.vis_id, v.beam, round(coalesce(m_re, 0.0e0), 5)+0.0e0 as m_re, round(coalesce(m_im, 0.0e0), 5)+0.0e0 as m_im from vis v left join m on m.vis_id = v.vis_id")
def forward(v):
    t = operator(v, "chan = 0").forward(v("fx_image"))
    return t.select("vis_id", "beam", r("m_re", 5).alias("m_re"), r("m_im", 5).alias("m_im"))


@query("q63", f"with {vis_sql('not flag')}, {INTERP}, {adjoint_sql('vis', 'a')} select chan, y, x, round(re, 2)+0.0e0 as re, round(im, 2)+0.0e0 as im from a")
def backward(v):
    op = operator(v)
    return op.adjoint(op.vis).select("chan", "y", "x", r("re", 2).alias("re"), r("im", 2).alias("im"))


_RES = "res as (select v.chan, v.beam, v.ur, v.vr, (m_re-re)/(sigma*sigma) as re, (m_im+im)/(sigma*sigma) as im from vis v join m on m.vis_id = v.vis_id)"


@query("q64", f"with {vis_sql('s.chan=1')}, {INTERP}, img as (select * from fx_image where chan=1), {forward_sql('img', 'm')}, {_RES}, {adjoint_sql('res', 'a')}, t as (select i.chan, i.y, i.x, i.value*{_T} as v from img i), t1 as (select chan, y, x, l as v from {_LAP} z), t2 as (select chan, y, x, l from {_LAP.replace('from t i', 'from t1 i').replace('join t ', 'join t1 ')} z) select a.y, a.x, round(a.re + 1.0e-2*2401.0e0*64.0e0*i.l*{_T}, 1)+0.0e0 as gradient from a join t2 i on i.y = a.y and i.x = a.x")
def gradient(v):
    image = v("fx_image").where("chan = 1")
    a = ob.data_gradient(operator(v, "chan = 1"), image)
    b = ob.laplacian_gradient(image, 8, 8, CELL, 1e-2, radius=0.6).select("chan", "y", "x", F.col("value").alias("l"))
    return a.join(b, ["chan", "y", "x"]).select("y", "x", r(F.col("value") + F.col("l"), 1).alias("gradient"))


@query("q74", f"with {vis_sql('beam=0 and s.chan=0 and not flag')}, maps as (select chan as k, y, x, value from fx_image where chan < 3), d as (select v.vis_id, i.k, 49.0e0*sum(i.value*cos({PHASE})) as re, 49.0e0*sum(i.value*sin({PHASE})) as im from vis v cross join maps i group by v.vis_id, i.k) select vis_id, b.chan, round(sum(d.re*b.value), 5)+0.0e0 as re, round(sum(d.im*b.value), 5)+0.0e0 as im from d join fx_basis b on b.k = d.k where b.chan < 3 group by vis_id, b.chan")
def channel_invariant(v):
    from ..operators import spectral

    vis = me.radpix(v("fx_stokes").where("beam = 0 and chan = 0 and not flag"), v("fx_channel"), CELL)
    coef = v("fx_image").where("chan < 3").withColumnRenamed("chan", "k")
    t = spectral.mixed_visibilities(vis, coef, v("fx_basis").where("chan < 3"), 8, 8, CELL)
    return t.select("vis_id", "chan", r("re", 5).alias("re"), r("im", 5).alias("im"))


@query("q77", f"with {vis_sql('beam=0 and s.chan=0 and not flag')}, b as (select min(wl) as lo, max(wl) as hi from vis), w as (select v.*, lo + (least(cast(floor((wl-lo)/((hi-lo)/5.0e0)) as int), 4)+0.5e0)*((hi-lo)/5.0e0) as wc from vis v cross join b) select vis_id, round(49.0e0*sum(i.value*cos({PHASE}+v.wc*pi()*r2)), 5)+0.0e0 as re, round(49.0e0*sum(i.value*sin({PHASE}+v.wc*pi()*r2)), 5)+0.0e0 as im from w v cross join (select y, x, value, ((y-4)*(y-4)+(x-4)*(x-4))*pow(7.0e0*pi()/648000.0e0, 2.0e0) as r2 from fx_image where chan=0) i group by vis_id")
def w_stacking(v):
    from ..operators import spectral

    vis = me.radpix(v("fx_stokes").where("beam = 0 and chan = 0 and not flag"), v("fx_channel"), CELL)
    t = spectral.w_stacked(vis, v("fx_image").where("chan = 0"), 8, 8, CELL, 5)
    return t.select("vis_id", r("m_re", 5).alias("re"), r("m_im", 5).alias("im"))


_RHS = "rhs_s as (select chan, beam, ur, vr, re/(sigma*sigma) as re, -im/(sigma*sigma) as im from vis where not flag)"


@query("q83", f"with {vis_sql('s.chan=2')}, {INTERP}, {_RHS}, {adjoint_sql('rhs_s', 'b')}, p as (select chan, y, x, re as value from b), {forward_sql('p', 'm')}, ns as (select v.chan, v.beam, v.ur, v.vr, m_re/(sigma*sigma) as re, m_im/(sigma*sigma) as im from vis v join m on m.vis_id = v.vis_id), {adjoint_sql('ns', 'n')}, s as (select sum(p.value*p.value)/sum(p.value*n.re) as alpha from p join n on n.y = p.y and n.x = p.x) select y, x, round(1000.0e0*alpha*value, 5)+0.0e0 as value from p cross join s")
def conjugate_gradient_step(v):
    from ..plans import solvers

    return solvers.cg_step(operator(v, "chan = 2")).select("y", "x", r(1000 * F.col("value"), 5).alias("value"))


@query("q84", f"with {vis_sql('s.chan=2')}, {INTERP}, {_RHS}, {adjoint_sql('rhs_s', 'b')} select y, x, round(greatest(1.0e-6*re, 0.0e0), 5)+0.0e0 as value from b")
def fista_step(v):
    from ..plans import solvers

    return solvers.fista_first_step(operator(v, "chan = 2"), 1e-6, positive=True).select("y", "x", r("value", 5).alias("value"))


# The same operators over all beams and channels.


def _good(v):
    return me.radpix(v("fx_stokes").where("not flag"), v("fx_channel"), CELL)


_DEGRID = f"with {vis_sql('not flag')} select v.vis_id, v.beam, v.chan, round(49.0e0*sum(i.value*cos({PHASE})), {{digits}})+0.0e0 as re, round(49.0e0*sum(i.value*sin({PHASE})), {{digits}})+0.0e0 as im from vis v join fx_image i on i.chan = v.chan group by v.vis_id, v.beam, v.chan"
_DIRTY = f"with {vis_sql('not flag')} select v.beam, v.chan, i.y, i.x, round(49.0e0*sum(v.re*cos({PHASE})+v.im*sin({PHASE})), {{digits}})+0.0e0 as re, round(49.0e0*sum(v.im*cos({PHASE})-v.re*sin({PHASE})), {{digits}})+0.0e0 as im from vis v cross join (select y, x from fx_image where chan=0) i group by v.beam, v.chan, i.y, i.x"


@query("q40_all", _DEGRID.format(digits=6))
def degrid_all(v):
    t = me.degrid(_good(v), v("fx_image"), 8, 8, CELL)
    return t.select("vis_id", "beam", "chan", r("m_re", 6).alias("re"), r("m_im", 6).alias("im"))


@query("q41_all", _DIRTY.format(digits=3))
def dirty_image_all(v):
    t = me.grid_adjoint(_good(v), v("fx_image").where("chan = 0"), 8, 8, CELL)
    return t.select("beam", "chan", "y", "x", r("re", 3).alias("re"), r("im", 3).alias("im"))


@query("q62_all", f"with {vis_sql()}, {INTERP}, {forward_sql('fx_image', 'm')} select v.vis_id, v.beam, v.chan, round(coalesce(m_re, 0.0e0), 5)+0.0e0 as m_re, round(coalesce(m_im, 0.0e0), 5)+0.0e0 as m_im from vis v left join m on m.vis_id = v.vis_id")
def forward_all(v):
    t = operator(v).forward(v("fx_image"))
    return t.select("vis_id", "beam", "chan", r("m_re", 5).alias("m_re"), r("m_im", 5).alias("m_im"))


@query("q64_all", f"with {vis_sql()}, {INTERP}, {forward_sql('fx_image', 'm')}, {_RES}, {adjoint_sql('res', 'a')}, t as (select i.chan, i.y, i.x, i.value*{_T} as v from fx_image i), t1 as (select chan, y, x, l as v from {_LAP} z), t2 as (select chan, y, x, l from {_LAP.replace('from t i', 'from t1 i').replace('join t ', 'join t1 ')} z) select a.chan, a.y, a.x, round(a.re + 1.0e-2*2401.0e0*64.0e0*i.l*{_T}, 1)+0.0e0 as gradient from a join t2 i on i.chan = a.chan and i.y = a.y and i.x = a.x")
def gradient_all(v):
    image = v("fx_image")
    a = ob.data_gradient(operator(v), image)
    b = ob.laplacian_gradient(image, 8, 8, CELL, 1e-2, radius=0.6).select("chan", "y", "x", F.col("value").alias("l"))
    return a.join(b, ["chan", "y", "x"]).select("chan", "y", "x", r(F.col("value") + F.col("l"), 1).alias("gradient"))


@query("q74_all", f"with {vis_sql('not flag')}, maps as (select chan as k, y, x, value from fx_image where chan < 3), d as (select v.vis_id, i.k, 49.0e0*sum(i.value*cos({PHASE})) as re, 49.0e0*sum(i.value*sin({PHASE})) as im from vis v cross join maps i group by v.vis_id, i.k) select vis_id, b.chan, round(sum(d.re*b.value), 5)+0.0e0 as re, round(sum(d.im*b.value), 5)+0.0e0 as im from d join fx_basis b on b.k = d.k join fx_channel c on c.chan = b.chan group by vis_id, b.chan")
def channel_invariant_all(v):
    from ..operators import spectral

    coef = v("fx_image").where("chan < 3").withColumnRenamed("chan", "k")  # a map for each row of the basis
    basis = v("fx_basis").join(v("fx_channel").select("chan"), "chan")
    t = spectral.mixed_visibilities(_good(v), coef, basis, 8, 8, CELL)
    return t.select("vis_id", "chan", r("re", 5).alias("re"), r("im", 5).alias("im"))


@query("q77_all", f"with {vis_sql('not flag')}, b as (select beam, chan, min(wl) as lo, max(wl) as hi from vis group by beam, chan), w as (select v.*, lo + (least(cast(floor((wl-lo)/((hi-lo)/5.0e0)) as int), 4)+0.5e0)*((hi-lo)/5.0e0) as wc from vis v join b on b.beam = v.beam and b.chan = v.chan) select vis_id, v.beam, v.chan, round(49.0e0*sum(i.value*cos({PHASE}+v.wc*pi()*r2)), 5)+0.0e0 as re, round(49.0e0*sum(i.value*sin({PHASE}+v.wc*pi()*r2)), 5)+0.0e0 as im from w v join (select chan, y, x, value, ((y-4)*(y-4)+(x-4)*(x-4))*pow(7.0e0*pi()/648000.0e0, 2.0e0) as r2 from fx_image) i on i.chan = v.chan group by vis_id, v.beam, v.chan")
def w_stacking_all(v):
    from ..operators import spectral

    t = spectral.w_stacked(_good(v), v("fx_image"), 8, 8, CELL, 5, ("beam", "chan"))
    return t.select("vis_id", "beam", "chan", r("m_re", 5).alias("re"), r("m_im", 5).alias("im"))


@query("q83_all", f"with {vis_sql()}, {INTERP}, {_RHS}, {adjoint_sql('rhs_s', 'b')}, p as (select chan, y, x, re as value from b), {forward_sql('p', 'm')}, ns as (select v.chan, v.beam, v.ur, v.vr, m_re/(sigma*sigma) as re, m_im/(sigma*sigma) as im from vis v join m on m.vis_id = v.vis_id), {adjoint_sql('ns', 'n')}, s as (select p.chan, sum(p.value*p.value)/sum(p.value*n.re) as alpha from p join n on n.chan = p.chan and n.y = p.y and n.x = p.x group by p.chan) select p.chan, y, x, round(1000.0e0*alpha*value, 5)+0.0e0 as value from p join s on s.chan = p.chan")
def conjugate_gradient_step_all(v):
    from ..plans import solvers

    return solvers.cg_step(operator(v)).select("chan", "y", "x", r(1000 * F.col("value"), 5).alias("value"))


@query("q83_joint", f"with {vis_sql()}, {INTERP}, {_RHS}, {adjoint_sql('rhs_s', 'b')}, p as (select chan, y, x, re as value from b), {forward_sql('p', 'm')}, ns as (select v.chan, v.beam, v.ur, v.vr, m_re/(sigma*sigma) as re, m_im/(sigma*sigma) as im from vis v join m on m.vis_id = v.vis_id), {adjoint_sql('ns', 'n')}, s as (select sum(p.value*p.value)/sum(p.value*n.re) as alpha from p join n on n.chan = p.chan and n.y = p.y and n.x = p.x) select chan, y, x, round(1000.0e0*alpha*value, 5)+0.0e0 as value from p cross join s")
def conjugate_gradient_step_joint(v):
    from ..plans import solvers

    return solvers.cg_step(operator(v), joint=True).select("chan", "y", "x", r(1000 * F.col("value"), 5).alias("value"))


@query("q84_all", f"with {vis_sql()}, {INTERP}, {_RHS}, {adjoint_sql('rhs_s', 'b')} select chan, y, x, round(greatest(1.0e-6*re, 0.0e0), 5)+0.0e0 as value from b")
def fista_step_all(v):
    from ..plans import solvers

    return solvers.fista_first_step(operator(v), 1e-6, positive=True).select("chan", "y", "x", r("value", 5).alias("value"))


# By gridding, held against the exact sums. The kernel's error is about 1e-11 of the largest value at spread 12 and that of
# rounding at 14; whole numbers would not do for q41_nufft, as exact sums lie on halves there.


@query("q40_nufft", _DEGRID.format(digits=1))
def degrid_by_gridding(v):
    t = nufft.forward(_good(v), v("fx_image"), 8, 8, CELL, spread=12)
    return t.select("vis_id", "beam", "chan", r("m_re", 1).alias("re"), r("m_im", 1).alias("im"))


@query("q41_nufft", _DIRTY.format(digits=3))
def dirty_image_by_gridding(v):
    t = nufft.adjoint(_good(v), 8, 8, CELL, spread=14)
    return t.select("beam", "chan", "y", "x", r("re", 3).alias("re"), r("im", 3).alias("im"))
