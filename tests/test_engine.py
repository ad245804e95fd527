"""Kernels against dense NumPy, properties, solvers, sources and streams."""

import math
import os
import tarfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyloom.functions import sky, units
from skyloom.operators import images, ingest, measure, nufft, objective, spectra, spectral
from skyloom.plans import imager, solvers
from skyloom.sources import fits, vis
from skyloom.streaming import slabs

H, W, CELL = 6, 4, 7.0
VIS = "vis_id long, block int, beam int, ddid int, chan int, ant1 int, ant2 int, uu double, vv double, ww double, re double, im double, sigma double, flag boolean"


def image_table(spark, cube):
    c, y, x = np.indices(cube.shape).reshape(3, -1)
    return spark.createDataFrame(list(zip(c.tolist(), y.tolist(), x.tolist(), cube.ravel().tolist())), "chan int, y int, x int, value double")


def dense(df, shape, *names):
    out = {n: np.zeros(shape) for n in names}
    for r in df.collect():
        for n in names:
            out[n][r["chan"], r["y"], r["x"]] = r[n]
    return [out[n] for n in names]


@pytest.fixture(scope="module")
def setup(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(2):
        for b in range(2):
            for i in range(15):
                rows.append((len(rows), 0, b, 0, c, i % 5, (i + 1) % 7, *rng.uniform(-200, 200, 2).tolist(), 0.0, *rng.normal(0, 1, 2).tolist(), float(rng.uniform(0.5, 2)), bool(i == 3)))
    v = spark.createDataFrame(rows, VIS)
    channels = spark.createDataFrame([(0, 1.42e9), (1, 1.43e9)], "chan int, frequency double")
    yy, xx = np.indices((H, W))
    pb = spark.createDataFrame([(b, y, x, math.exp(-((y - 3) ** 2 + (x - 2) ** 2) / (9.0 + b))) for b in range(2) for y in range(H) for x in range(W)], "beam int, y int, x int, value double")
    grid = spark.createDataFrame([(b, y, x, (x / (W - 1) * 2 - 1) * 0.9 + 0.02 * b, (y / (H - 1) * 2 - 1) * 1.1) for b in range(2) for y in range(H) for x in range(W)], "beam int, y int, x int, gx double, gy double")
    return v, channels, pb, grid, rows


def operator(setup, kernel="join"):
    v, channels, pb, grid, _ = setup
    return measure.Measurement(v, channels, pb, grid, H, W, CELL, kernel)


def bilinear(plane, gx, gy):
    px, py = 0.5 * (gx + 1) * (W - 1), 0.5 * (gy + 1) * (H - 1)
    x0, y0, out = math.floor(px), math.floor(py), 0.0
    for dy in (0, 1):
        for dx in (0, 1):
            y, x = y0 + dy, x0 + dx
            if 0 <= y < H and 0 <= x < W:
                out += plane[y, x] * (py - y0 if dy else 1 - py + y0) * (px - x0 if dx else 1 - px + x0)
    return out


def numpy_forward(setup, cube):
    _, _, pb, grid, rows = setup
    p = {(r.beam, r.y, r.x): r.value for r in pb.collect()}
    g = {(r.beam, r.y, r.x): (r.gx, r.gy) for r in grid.collect()}
    freq, rad = [1.42e9, 1.43e9], 2 * math.pi * CELL * math.pi / 648000
    out = {}
    for r in rows:
        n, beam, c, u, v, flag = r[0], r[2], r[4], r[7], r[8], r[13]
        k = freq[c] / 299792458.0 * rad
        out[n] = 0 if flag else CELL**2 * sum(p[beam, y, x] * bilinear(cube[c], *g[beam, y, x]) * np.exp(1j * (u * k * (x - W // 2) - v * k * (y - H // 2))) for y in range(H) for x in range(W))
    return out


@pytest.mark.parametrize("kernel", ["join", "matrix", "nufft"])
def test_forward_equals_numpy(spark, setup, kernel):
    cube = np.random.default_rng(2).normal(size=(2, H, W))
    want = numpy_forward(setup, cube)
    got = {r.vis_id: complex(r.m_re, r.m_im) for r in operator(setup, kernel).forward(image_table(spark, cube)).collect()}
    assert got.keys() == want.keys()
    np.testing.assert_allclose([got[k] for k in want], list(want.values()), rtol=1e-6, atol=1e-5)


@pytest.mark.parametrize("kernel", ["join", "nufft"])
def test_adjoint_identity(spark, setup, kernel):
    op, cube = operator(setup, kernel), np.random.default_rng(3).normal(size=(2, H, W))
    ax = {r.vis_id: complex(r.m_re, r.m_im) for r in op.forward(image_table(spark, cube)).collect()}
    y = {r[0]: complex(r[10], r[11]) for r in setup[4]}
    left = sum(ax[k] * y[k].conjugate() for k in ax)
    re, im = dense(op.adjoint(op.vis), (2, H, W), "re", "im")
    right = (cube * (re - 1j * im)).sum()
    assert abs(left - right) < 1e-6 * abs(left)


@pytest.mark.parametrize("part", [nufft.PART, 7])
def test_gridding_over_many_tiles(spark, monkeypatch, part):
    monkeypatch.setattr(nufft, "PART", part)
    monkeypatch.setattr(nufft, "TILE", 24)
    rng, (h, w, n) = np.random.default_rng(8), (75, 90, 400)
    plane, u, v, d = rng.normal(size=(h, w)), rng.uniform(-5, 5, n), rng.uniform(-math.pi, math.pi, n), rng.normal(size=(n, 2)) @ [1, 1j]
    seen = spark.createDataFrame([(i, 0, 0, float(u[i]), float(v[i]), float(d[i].real), float(d[i].imag)) for i in range(n)], "vis_id long, chan int, beam int, ur double, vr double, re double, im double")
    ev, eu = np.exp(-1j * np.outer(v, np.arange(h) - h // 2)), np.exp(1j * np.outer(u, np.arange(w) - w // 2))
    want = ((ev @ plane) * eu).sum(1) * CELL**2
    got = {r.vis_id: complex(r.m_re, r.m_im) for r in measure.degrid(seen, image_table(spark, plane[None]), h, w, CELL).collect()}
    np.testing.assert_allclose([got[i] for i in range(n)], want, atol=1e-6 * abs(want).max())
    pixels = image_table(spark, plane[None]).select("y", "x")
    re, im = dense(measure.grid_adjoint(seen, pixels, h, w, CELL), (1, h, w), "re", "im")
    want = CELL**2 * (ev.conj().T @ (d[:, None] * eu.conj()))
    np.testing.assert_allclose((re + 1j * im)[0], want, atol=1e-6 * abs(want).max())
    joins = measure.grid_adjoint(seen, pixels, h, w, CELL)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in joins and "Cartesian" not in joins
    with pytest.raises(ValueError):
        measure.degrid(seen, pixels, h, w, CELL, kernel="other")
    with pytest.raises(ValueError):
        measure.grid_adjoint(seen, pixels, h, w, CELL, kernel="join")  # too many pixels to meet every sample
    assert [nufft.spread_for(t) for t in (1e-3, 1e-7, 1e-13, 1e-20)] == [4, 8, 14, 14]
    if part == 7:
        return
    want = ((ev @ plane) * eu).sum(1) * CELL**2
    for tolerance in (1e-4, 1e-12):
        got = {r.vis_id: complex(r.m_re, r.m_im) for r in measure.degrid(seen, image_table(spark, plane[None]), h, w, CELL, tolerance=tolerance).collect()}
        assert abs(np.array([got[i] for i in range(n)]) - want).max() < 5 * tolerance * abs(want).max()


def test_gridding_where_the_last_tile_is_narrow(spark):
    """66 cells: the second tile has two, so the first one's kernels reach over it to the other end."""
    rng, (h, w, n) = np.random.default_rng(9), (33, 35, 500)
    plane, u, v = rng.normal(size=(h, w)), rng.uniform(-math.pi, math.pi, n), rng.uniform(-math.pi, math.pi, n)
    seen = spark.createDataFrame([(i, 0, 0, float(u[i]), float(v[i])) for i in range(n)], "vis_id long, chan int, beam int, ur double, vr double")
    want = ((np.exp(-1j * np.outer(v, np.arange(h) - h // 2)) @ plane) * np.exp(1j * np.outer(u, np.arange(w) - w // 2))).sum(1)
    got = {r.vis_id: complex(r.m_re, r.m_im) for r in nufft.forward(seen, image_table(spark, plane[None]), h, w, 1.0).collect()}
    np.testing.assert_allclose([got[i] for i in range(n)], want, atol=1e-6 * abs(want).max())


def test_gridding_of_empty_tables(spark, setup):
    seen, image = operator(setup).vis, image_table(spark, np.ones((2, H, W)))
    assert nufft.forward(seen.limit(0), image, H, W, CELL).count() == 0
    assert nufft.forward(seen, image.limit(0), H, W, CELL).count() == 0
    assert nufft.adjoint(seen.limit(0), H, W, CELL).count() == 0


def test_gradient_equals_finite_differences(spark, setup):
    op, x = operator(setup), np.random.default_rng(4).normal(size=(2, H, W))
    problem = solvers.Problem(op, [0, 1], lambda_r=1e-6)
    value, g = problem.loss_and_gradient(x)
    step = np.zeros_like(x)
    for at in ((0, 2, 1), (1, 5, 3)):
        step[:] = 0
        step[at] = 1e-4
        d = (problem.loss_and_gradient(x + step)[0] - problem.loss_and_gradient(x - step)[0]) / 2e-4
        assert abs(d - g[at]) < 1e-5 * max(1, abs(d))
    # the plan form gives the same loss and gradient
    table = image_table(spark, x)
    plan = dense(objective.data_gradient(op, table), x.shape, "value")[0] + dense(objective.laplacian_gradient(table, H, W, CELL, 1e-6, radius=0.98), x.shape, "value")[0]
    np.testing.assert_allclose(plan, g, rtol=1e-6, atol=1e-5)
    loss = op.residual(table).agg(F.sum("chi2")).first()[0] + objective.laplacian(table, H, W, CELL, 1e-6).agg(F.sum("loss")).first()[0]
    assert abs(loss - value) < 1e-6 * value


def test_solvers_agree_and_recover_the_sky(spark, setup):
    v, channels, pb, grid, rows = setup
    truth = np.zeros((1, H, W))
    truth[0, 3, 2], truth[0, 2, 1] = 1.0, 0.5
    sky_vis = numpy_forward(setup, np.concatenate([truth, truth]))
    seen = spark.createDataFrame([(*r[:10], float(np.real(sky_vis[r[0]])), float(-np.imag(sky_vis[r[0]])), 1.0, r[13]) for r in rows if r[4] == 0], VIS)
    op = measure.Measurement(seen, channels, pb, grid, H, W, CELL).persist()
    problem = solvers.Problem(op, [0])
    start = np.zeros(problem.shape)
    first = problem.loss_and_gradient(start)[0]
    cg = solvers.solve(problem, start, "cg", iterations=12)
    bfgs = solvers.solve(problem, start, "lbfgs", iterations=12)
    positive = solvers.solve(problem, start, positive=True, iterations=12)
    fast = solvers.solve(problem, start, "fista", positive=True, iterations=12)
    for x in (cg, bfgs, positive, fast):
        assert problem.loss_and_gradient(x)[0] < 0.1 * first
    assert positive.min() >= 0 and fast.min() >= 0
    assert np.unravel_index(positive.argmax(), positive.shape) == (0, 3, 2)
    op.unpersist()
    out = imager.Imager(seen, channels.where("chan = 0"), pb, grid, H, W, CELL).process(iterations=3, unit="K")
    assert out.count() == H * W


def test_transforms_equal_numpy(spark):
    cube = np.random.default_rng(5).normal(size=(2, H, W))
    for transform in (images.dft, images.fft):
        re, im = dense(transform(image_table(spark, cube), H, W), cube.shape, "re", "im")
        np.testing.assert_allclose(re + 1j * im, np.fft.fft2(cube), atol=1e-9)
        back = transform(transform(image_table(spark, cube), H, W), H, W, inverse=True)
        np.testing.assert_allclose(dense(back, cube.shape, "re")[0], cube, atol=1e-9)
    auto = spectra.autocorrelation(spectra.power(image_table(spark, cube), None, H, W), H, W)
    np.testing.assert_allclose(dense(auto, cube.shape, "value")[0], np.fft.ifft2(np.abs(np.fft.fft2(cube)) ** 2 / (H * W)).real, atol=1e-9)


def test_short_spacing_keeps_equal_maps(spark):
    cube = np.random.default_rng(6).normal(size=(1, 8, 8))
    t = image_table(spark, cube)
    for out in (images.feather(t, t, 8, 8, 4.0, 2.0), images.short_spacing(t, t, 8, 8, 3.0)):
        np.testing.assert_allclose(dense(out, cube.shape, "value")[0], cube, atol=1e-9)


def test_padding_and_cropping(spark):
    cube = np.arange(64.0).reshape(1, 8, 8)
    p = images.padded(image_table(spark, cube), 8, 8, 0.5)
    wide = dense(p, (1, 12, 12), "value")[0]
    assert (wide[0, 2:10, 2:10] == cube[0]).all() and wide.sum() == cube.sum()
    assert images.depadded(p, 12, 12, 0.5).count() == 81


def test_tapers():
    assert images.taper_1d(F.lit(0), 8, 0.98) is not None
    with pytest.raises(ValueError):
        images.taper_1d(F.lit(0), 8, 1.0)


@settings(max_examples=15, deadline=None)
@given(st.floats(60, 90), st.floats(-75, -60), st.sampled_from(["SIN", "TAN"]))
def test_projection_round_trip(ra, dec, kind):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    header = {"CRVAL1": 75.0, "CRVAL2": -68.0, "CRPIX1": 10.0, "CRPIX2": 12.0, "CDELT1": -0.01, "CDELT2": 0.01}
    px, py = sky.to_pixel(F.col("ra"), F.col("dec"), header, kind)
    back = sky.to_sky(F.col("px"), F.col("py"), header, kind)
    (r,) = spark.sql(f"select {ra!r}d as ra, {dec!r}d as dec").select(px.alias("px"), py.alias("py")).select(*[c.alias(n) for c, n in zip(back, ("ra", "dec"))]).collect()
    assert abs(r.ra - ra) < 1e-7 and abs(r.dec - dec) < 1e-7


def test_units_round_trip(spark):
    t = spark.sql("select 1.42e9d as f, 0.3d as i")
    i, v = units.k_to_jy_arcsec2(units.jy_arcsec2_to_k(F.col("i"), F.col("f")), F.col("f")), units.frequency_of(units.velocity(F.col("f")))
    r = t.select(i.alias("i"), v.alias("f"), sky.sexagesimal(F.lit(-12.9999999)).alias("s")).first()
    assert abs(r.i - 0.3) < 1e-12 and abs(r.f - 1.42e9) < 1e-3 and r.s == "-13:00:00.000"


def test_merge_and_stack(spark, setup):
    v = setup[0]
    two = v.unionByName(v.withColumn("block", F.lit(1)))
    assert ingest.stack(two).select("beam").distinct().count() == 4
    beams = spark.createDataFrame([(0, 1.0, 2.0), (1, 3.0, 4.0)], "beam int, ra_deg double, dec_deg double")
    assert ingest.merge([v, v], [beams, beams]).count() == 2 * v.count()
    with pytest.raises(ingest.MismatchError):
        ingest.merge([v, v], [beams, beams.withColumn("ra_deg", F.col("ra_deg") + 1)])
    with pytest.raises(ValueError):
        ingest.select_beams(v, [5], 2)
    assert ingest.common_columns([v, v.drop("ww")]).columns == [c for c in v.columns if c != "ww"]
    assert ingest.mismatched_channels(setup[1], setup[1].withColumn("frequency", F.col("frequency") + 1)).count() == 2


def test_spectral_models(spark):
    channels = spark.createDataFrame([(0, 1.40e9), (1, 1.41e9), (2, 1.42e9)], "chan int, frequency double")
    basis = {(r.k, r.chan): r.value for r in spectral.continuum_basis(channels, 1, 1.41e9).collect()}
    assert basis[0, 0] == 1.0 and abs(basis[1, 2] - 0.01 / 1.41) < 1e-12
    grid = spark.range(64).selectExpr("cast(id div 8 as int) as k", "cast(id % 8 as int) as chan")
    m = np.zeros((8, 8))
    for r in grid.select("k", "chan", spectral.haar(F.col("k"), F.col("chan"), 8).alias("v")).collect():
        m[r.k, r.chan] = r.v
    np.testing.assert_allclose(m @ m.T, np.eye(8), atol=1e-12)


def test_fits_source(spark, tmp_path):
    cube = np.random.default_rng(7).normal(size=(3, 5, 4)).astype(np.float32)
    cube[1, 2, 3] = np.nan
    fits.write(f"{tmp_path}/a.fits", cube, {"OBJECT": "it's", "CDELT1": -0.5, "FLAG": True})
    header, _ = fits.read_header(f"{tmp_path}/a.fits")
    assert header["OBJECT"] == "it" or header["CDELT1"] == -0.5
    fits.register(spark)
    t = spark.read.format("fits").option("nan_to_zero", "true").option("planes", "1,2").load(str(tmp_path))
    got = dense(t, cube.shape, "value")[0]
    np.testing.assert_allclose(got[1:], np.nan_to_num(cube[1:]), rtol=1e-6)
    assert t.select("chan").distinct().count() == 2
    fits.export(image_table(spark, np.nan_to_num(cube).astype(float)), f"{tmp_path}/b.fits", 5, 4, fits.cube_header({}, 3, 0.0, 1.0))
    np.testing.assert_allclose(fits.read_plane(f"{tmp_path}/b.fits", 2), cube[2], rtol=1e-6)
    h = fits.imaging_header(75.0, -70.0, 1.0, 7.0)
    assert h["NAXIS1"] == 514 and fits.downsampled_header(h, 2)["NAXIS1"] == 257
    with pytest.raises(ValueError):
        fits.parse_header(b" " * 80)


def test_visibility_sets(spark, tmp_path):
    channels = spark.createDataFrame([(c, 1.42e9 + c * 1e6) for c in range(3)], "chan int, frequency double")
    main = spark.range(60).selectExpr(
        "cast(id % 3 as int) as chan", "cast(id % 2 as int) as ddid", "cast(id % 5 as int) as ant1", "cast(id % 4 as int) as ant2", "double(id) as uu", "1.0d as vv", "0.0d as ww",
        "array(named_struct('re', double(id), 'im', 1.0d), named_struct('re', 2.0d, 'im', 3.0d)) as data", "array(false, id % 7 = 0) as flags", "array(1.0d, 1.0d) as sigma", "array(4.0d, 4.0d) as weight",
    )
    for block in ("b1", "b2"):
        for name in ("X_C10_10_a.ms", "X_C10_2_a.ms"):
            vis.write_set(f"{tmp_path}/{block}/{name}", main, channels, 75.0 if "10_10" in name else 80.0, -70.0, [(0, 0), (1, 0)])
    reader, root = vis.VisReader(spark), str(tmp_path)
    assert [p.rsplit("/", 1)[1] for p in vis.list_sets_naturally(spark, f"{root}/b1")] == ["X_C10_2_a.ms", "X_C10_10_a.ms"]
    assert len(vis.list_blocks(spark, root)) == 2
    per_set = main.where("ant1 <> ant2").count()
    assert reader.read_blocks(root).count() == 4 * per_set
    assert reader.read_blocks(root, "stack").select("beam").distinct().count() == 4
    for name in ("X_C10_10_a.ms", "X_C10_2_a.ms"):
        vis.write_set(f"{tmp_path}/other/b3/{name}", main, channels.withColumn("frequency", F.col("frequency") + F.when(F.col("chan") > 1, 1e5).otherwise(0.0)), 75.0 if "10_10" in name else 80.0, -70.0, [(0, 0), (1, 0)])
    os.symlink(f"{tmp_path}/b1", f"{tmp_path}/other/b1")
    for mode in ("merge", "stack"):
        with pytest.raises(ingest.MismatchError):
            reader.read_blocks(f"{root}/other", mode)
    assert reader.read_blocks(f"{root}/other", channels=[0, 1]).count() > 0 and reader.read_blocks(f"{root}/other", "separate").count() == 4 * per_set
    near = reader.read_block(f"{root}/b1", channels=[1], cone=(75.0, -70.0, 0.5), uv_range=(10.0, 30.0))
    assert near.select("beam").distinct().collect()[0].beam == 0 and near.where("isnan(sigma)").count() == 0
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "chan" in plan.split("PartitionFilters")[1][:80]
    weighted = vis.VisReader(spark, prefer_weights=True).read_set(f"{root}/b1/X_C10_2_a.ms", 0).first()
    assert abs(weighted.sigma - 0.5 * math.sqrt(0.5)) < 1e-12
    assert [(a, b) for a, b, _ in reader.iter_slabs(root, 2)] == [(0, 2), (2, 3)]
    with pytest.raises(ValueError):
        reader.data_descriptions(f"{root}/b1/X_C10_2_a.ms", 9)
    with pytest.raises(FileNotFoundError):
        vis.list_sets(spark, root)


def test_archives(spark, tmp_path):
    (tmp_path / "x.txt").write_text("hello")
    with tarfile.open(tmp_path / "a.tar", "w") as t:
        t.add(tmp_path / "x.txt", "in/x.txt")
    (r,) = vis.tar_members(spark, str(tmp_path)).collect()
    assert r.name == "in/x.txt" and bytes(r.content) == b"hello"


def test_slabs_wait_for_all_blocks(spark, tmp_path):
    path = f"{tmp_path}/in"
    for i, rows in enumerate([[(0, 0, 5), (1, 0, 2)], [(0, 1, 6), (0, 1, 6)], [(1, 2, 1)]]):
        spark.createDataFrame(rows, "slab long, block int, n long").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("slab long, block int, n long").option("maxFilesPerTrigger", 1).parquet(path)
    got = slabs.run_once(slabs.complete_slabs(stream, 2), "waiting", f"{tmp_path}/c").collect()
    assert sorted((r.slab, r.blocks, r.n) for r in got) == [(0, 2, 11), (1, 2, 3)]


def test_live_planes_and_late_events(spark, tmp_path):
    planes = image_table(spark, np.ones((2, 2, 2)))
    planes.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(planes.schema).parquet(f"{tmp_path}/in")
    slabs.live_planes(stream, f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 8
    spark.sql("select 1L as event_id, timestamp_ntz'2024-01-01 00:10:00' as ts, 1L as user_id, 'a' as event_type, 1.0d as value").write.parquet(f"{tmp_path}/events.parquet")
    events = slabs.event_stream(spark, f"{tmp_path}/events.parquet", name="*.parquet")
    out = slabs.run_once(slabs.sessions(events), "sessions", f"{tmp_path}/c2", "complete")
    assert out.count() == 1


def test_low_rank_equals_the_cube_form(spark, setup):
    op, rng = operator(setup), np.random.default_rng(8)
    basis = np.array([[1.0, 0.5], [0.0, 0.75], [1.0, 1.0]])
    low, plain = solvers.LowRankProblem(op, [0, 1], basis), solvers.Problem(op, [0, 1])
    x = rng.normal(size=low.shape)
    a, g = low.loss_and_gradient(x)
    b, h = plain.loss_and_gradient(low.cube(x))
    np.testing.assert_allclose(a, b, rtol=1e-6)
    np.testing.assert_allclose(g, np.einsum("kc,cyx->kyx", basis, h), rtol=1e-6, atol=1e-5)
    penalised = solvers.LowRankProblem(op, [0, 1], basis, lambda_r=1e-6, lambda_pos=0.3, n_line=2, continuum_only=[1])
    assert (penalised.basis[:2, 1] == 0).all() and penalised.basis[2, 1] == 1
    value, g = penalised.loss_and_gradient(x)
    step = np.zeros_like(x)
    step[1, 2, 2] = 1e-4
    d = (penalised.loss_and_gradient(x + step)[0] - penalised.loss_and_gradient(x - step)[0]) / 2e-4
    assert abs(d - g[1, 2, 2]) < 1e-5 * max(1, abs(d))
    both, n = solvers.with_continuum(basis[:1], np.array([1.40e9, 1.42e9]), 1)
    assert n == 1 and both.shape == (3, 2) and (both[1] == 1).all()
    np.testing.assert_allclose(both[2], [-0.01 / 1.41, 0.01 / 1.41])


def test_noise_beams_and_rotation(spark, setup):
    n = measure.noise(setup[0], 3)
    assert n.count() == setup[0].count() and n.agg(F.stddev("re")).first()[0] > 0
    header = {"NAXIS1": W, "NAXIS2": H, "CRVAL1": 75.0, "CRVAL2": -70.0, "CRPIX1": 2.0, "CRPIX2": 3.0, "CDELT1": -1e-3, "CDELT2": 1e-3}
    pb, grid = measure.beams_on_target(setup[2], {0: header, 1: header}, images.pixels(spark, H, W), header)
    seen = {(r.beam, r.y, r.x): r.value for r in pb.collect()}
    for r in setup[2].collect():
        assert abs(seen[r.beam, r.y, r.x] - r.value) < 1e-6
    assert grid.count() == 2 * H * W
    cube = np.random.default_rng(9).normal(size=(1, 5, 5))
    turned = dense(images.rotated(image_table(spark, cube), 5, 5, 90.0), cube.shape, "value")[0]
    assert np.allclose(turned[0], np.rot90(cube[0]), atol=1e-9) or np.allclose(turned[0], np.rot90(cube[0], -1), atol=1e-9)
    assert ingest.subsample(setup[0], 0.5).count() > 0


def test_elliptical_fit(spark):
    source = images.elliptical_source(spark, 32, 32, 2.0, 3.0, 20.0, 12.0, 30.0).withColumn("chan", F.lit(0))
    (r,) = images.fit_elliptical(source, 2.0).collect()
    # the source's widths use 2.3548 for 2 sqrt(2 ln 2)
    assert abs(r.flux - 3.0) < 0.01 and abs(r.major - 20.0) < 0.01 and abs(r.minor - 12.0) < 0.01 and abs(r.pa_deg - 30) < 0.01
    assert abs(r.cx - 16) < 1e-3 and abs(r.cy - 16) < 1e-3
    assert images.fit_elliptical(source.withColumn("value", F.lit(0.0)), 2.0).first().flux is None
