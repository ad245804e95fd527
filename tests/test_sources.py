"""Byte ranges of archives and images, the FITS writer of many tasks, cubes' offsets, percentiles and regridding."""

import io
import os
import tarfile

import numpy as np
import pytest

from skyloom.operators import ingest, spectra, spectral
from skyloom.sources import fits, ranges

from .test_engine import dense, image_table


def archive(path, members):
    with tarfile.open(path, "w") as t:
        for name, content in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(content)
            t.addfile(info, io.BytesIO(content))


def test_archives_by_range(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "PIECE", 10_000)
    rng = np.random.default_rng(1)
    members = {"a/empty": b"", "b.bin": rng.bytes(200_000), "long" * 40: b"x" * 511, "c": b"y" * 512, "d": rng.bytes(70_001)}
    archive(tmp_path / "one.tar", members)
    archive(tmp_path / "two.tar", {"only": b"z" * 3})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    got = ranges.tar_pieces(spark, str(tmp_path)).collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    found = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert len(r.content) <= 10_000
        whole = found.setdefault((os.path.basename(r.archive), r.name), bytearray())
        assert len(whole) == r.offset
        whole += r.content
        assert r.size >= len(whole)
    assert {k[1]: bytes(v) for k, v in found.items() if k[0] == "one.tar"} == members and found["two.tar", "only"] == b"zzz"
    assert {r.name for r in ranges.tar_pieces(spark, f"{tmp_path}/one.tar", "^b").collect()} == {"b.bin"}
    with pytest.raises(FileNotFoundError):
        ranges.tar_pieces(spark, f"{tmp_path}/none")


def test_images_by_range_and_by_a_path_that_only_spark_opens(spark, tmp_path):
    cube = np.random.default_rng(7).normal(size=(3, 50, 41)).astype(np.float32)
    cube[1, 2, 3] = np.nan
    fits.write(f"{tmp_path}/a.fits", cube, {"OBJECT": "x"})
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.there.link./in", f"file://{tmp_path}")
    for path in (str(tmp_path), "viewfs://there/in/a.fits"):
        t = ranges.fits_pixels(spark, path, nan_to_zero=True)
        np.testing.assert_allclose(dense(t, cube.shape, "value")[0], np.nan_to_num(cube), rtol=1e-6)
        assert t.count() == cube.size
    some = ranges.fits_pixels(spark, "viewfs://there/in/a.fits", [2])
    assert some.select("chan").distinct().collect()[0].chan == 2 and some.count() == 50 * 41
    archive(tmp_path / "t.tar", {"k": b"abc" * 1000})
    assert b"".join(r.content for r in ranges.tar_pieces(spark, "viewfs://there/in/t.tar").orderBy("offset").collect()) == b"abc" * 1000


def test_fits_is_written_by_tasks(spark, tmp_path):
    cube = np.random.default_rng(3).normal(size=(3, 20, 13))
    table = image_table(spark, cube).selectExpr("chan * 10 as chan", "y", "x", "value").where("not (chan = 10 and y = 4)").repartition(5)
    fits.export(table, f"{tmp_path}/c.fits", 20, 13, {"OBJECT": "field", "CDELT1": -0.5})
    want = cube.copy()
    want[1, 4] = 0
    header, _ = fits.read_header(f"{tmp_path}/c.fits")
    assert header["NAXIS3"] == 3 and header["OBJECT"] == "field" and os.path.getsize(f"{tmp_path}/c.fits") % 2880 == 0
    assert os.listdir(tmp_path) == ["c.fits"]
    for c in range(3):
        np.testing.assert_allclose(fits.read_plane(f"{tmp_path}/c.fits", c), want[c], rtol=1e-6)


def test_cubes_behind_one_another(spark):
    cubes = spark.createDataFrame([("b", 735 + 30, 20), ("a", 735, 30), ("c", 785, 5)], "cube string, first long, n long")
    assert {r.cube: r.offset for r in ingest.channel_offsets(cubes).collect()} == {"a": 0, "b": 30, "c": 50}
    planes = spark.createDataFrame([("b", 3, 0, 0, 1.5), ("a", 3, 0, 0, 2.5)], "cube string, chan int, y int, x int, value double")
    assert {(r.chan, r.value) for r in ingest.merge_cubes(planes, cubes).collect()} == {(33, 1.5), (3, 2.5)}
    for first in (784, 786):  # an overlap, a gap
        with pytest.raises(ingest.MismatchError):
            ingest.channel_offsets(cubes.where("cube <> 'c'").union(spark.createDataFrame([("c", first, 5)], cubes.schema)))


def test_percentiles_of_odd_planes(spark):
    rng = np.random.default_rng(2)
    planes = {0: rng.normal(size=999), 1: np.repeat([1.0, 1.0, 2.0], 50), 2: np.array([-1e308, 1e308, 0.0, 5e-324]), 3: np.array([7.0]), 4: np.append(np.full(20, np.nan), 3.0), 5: 10.0 ** rng.uniform(-300, 300, 500)}
    rows = [(c, float(v)) for c, p in planes.items() for v in p] + [(6, float("nan")), (0, None)]
    got = {r.chan: (r.lo, r.hi) for r in spectra.percentiles(spark.createDataFrame(rows, "chan int, value double"), 0.05, 0.997).collect()}
    assert got.pop(6) == (None, None) and got.keys() == planes.keys()
    for c, p in planes.items():
        p = p[~np.isnan(p)]
        if c == 2:
            continue  # NumPy's own interpolation overflows
        np.testing.assert_allclose(got[c], np.quantile(p, [0.05, 0.997]), rtol=1e-9)
    assert spectra.percentiles(spark.createDataFrame([], "chan int, value double"), 0.1, 0.9).count() == 0


def test_regridding_conserves_flux(spark):
    rng = np.random.default_rng(4)
    rest, c = 1.42040575177e9, 299792.458
    freq = rest + np.cumsum(rng.uniform(0.5e6, 1.5e6, 8)) - 4e6
    channels = spark.createDataFrame([(i, float(f)) for i, f in enumerate(freq)], "chan int, frequency double")
    rows = spark.createDataFrame([(b, i, float(rng.normal()), 0.5, b == 1 and i == 2) for b in range(2) for i in range(8)], "beam int, chan int, re double, sigma double, flag boolean")
    out = spectral.regrid(rows, channels, 60, -1200.0, 41.0, ["beam"], ["re"]).collect()
    edges = np.concatenate([[freq[0] - (freq[1] - freq[0]) / 2], (freq[1:] + freq[:-1]) / 2, [freq[-1] + (freq[-1] - freq[-2]) / 2]])
    widths = np.diff(edges) / rest * c
    for beam in range(2):
        mine = [r for r in out if r.beam == beam]
        want = sum(r.re * widths[r.chan] for r in rows.collect() if r.beam == beam and not r.flag)
        assert sum(r.re * r.coverage * 41.0 for r in mine) == pytest.approx(want)
        assert all(0 < r.coverage <= 1 + 1e-12 and r.velocity == pytest.approx(-1200 + 41 * r.chan) for r in mine)
    assert spectral.regrid(rows.limit(0), channels, 5, 0.0, 1.0, ["beam"], ["re"]).count() == 0


def test_principal_spectra(spark):
    cube = np.random.default_rng(6).normal(size=(4, 9, 7)) * np.array([3.0, 2.0, 1.0, 0.5])[:, None, None]
    basis, mean, variance = spectral.principal_basis(image_table(spark, cube), 4)
    flat = cube.reshape(4, -1).T
    values, vectors = np.linalg.eigh(np.cov(flat.T))
    got = np.zeros((4, 4))
    for r in basis.collect():
        got[r.k, r.chan] = r.value
    np.testing.assert_allclose(np.abs(got), np.abs(vectors.T[::-1]), atol=1e-8)
    assert all(g[np.abs(g).argmax()] > 0 for g in got)
    np.testing.assert_allclose([r.variance for r in variance.orderBy("k").collect()], values[::-1])
    np.testing.assert_allclose([r.value for r in mean.orderBy("chan").collect()], flat.mean(0))


def test_windows_and_sets_that_fail(spark, tmp_path):
    from skyloom.sources import vis

    assert vis.windows_of(None, [0, 2], 3) == [None, None] and vis.windows_of(4, [0, 2], 3) == [4, 4]
    assert vis.windows_of([5, 6], [0, 2], 3) == [5, 6] and vis.windows_of([5, 6, 7], [0, 2], 3) == [5, 7]
    for wrong, error in (([1], ValueError), ("12", TypeError), (1.5, TypeError)):
        with pytest.raises(error):
            vis.windows_of(wrong, [0, 2], 3)
    channels = spark.createDataFrame([(0, 1.42e9)], "chan int, frequency double")
    main = spark.range(8).selectExpr(
        "0 as chan", "cast(id % 2 as int) as ddid", "cast(id % 5 as int) as ant1", "7 as ant2", "double(id) as uu", "1.0d as vv", "0.0d as ww",
        "array(named_struct('re', double(id), 'im', 1.0d)) as data", "array(false) as flags", "array(1.0d) as sigma",
    )
    for name in ("a.ms", "c.ms"):
        vis.write_set(f"{tmp_path}/{name}", main, channels, 75.0, -70.0, [(0, 0), (1, 1)])
    os.makedirs(f"{tmp_path}/b.ms/main")
    reader = vis.VisReader(spark)
    with pytest.raises(Exception):
        reader.read_block(str(tmp_path))
    with pytest.warns(UserWarning, match="b.ms"):
        seen = reader.read_block(str(tmp_path), skip_failed=True)
    assert {(r.beam, r["count"]) for r in seen.groupBy("beam").count().collect()} == {(0, 8), (2, 8)}
    some = reader.read_block(str(tmp_path), beams=[0, 2], spw=[1, 0])
    assert {(r.beam, r.ddid) for r in some.select("beam", "ddid").distinct().collect()} == {(0, 1), (2, 0)}


def test_lists_that_must_agree(spark):
    a = spark.createDataFrame([("x",), ("y",)], "name string")
    with pytest.raises(ingest.MismatchError):
        ingest.paired(a, a.limit(1).selectExpr("name as other"), "name", "other")
    good = spark.createDataFrame([("MS_M345-09A_MS_M345-09C_beam7.ms",), ("MS_M1B_beam123",)], "name string")
    assert [tuple(r)[1:] for r in ingest.beam_files(good).orderBy("beam").collect()] == [("C", 7, "ASKAP_BEAM07.fits"), ("B", 123, "ASKAP_BEAM123.fits")]
    for bad in ("MS_M345-09A_x", "beam7", "MS_M345-09D_beam3"):
        with pytest.raises(ValueError):
            ingest.beam_files(spark.createDataFrame([(bad,)], "name string"))


def test_planes_outside_the_axis_and_feathering(spark):
    from skyloom.operators import images

    cube = np.random.default_rng(3).normal(size=(3, 8, 8))
    table = image_table(spark, cube)
    channels = spark.createDataFrame([(0, 3.0), (1, 2.0), (2, 1.0)], "chan int, frequency double")
    at = lambda f: dense(images.plane_at(table, channels, f).selectExpr("0 as chan", "y", "x", "value"), (1, 8, 8), "value")[0][0]
    np.testing.assert_allclose(at(2.25), 0.75 * cube[1] + 0.25 * cube[0])
    np.testing.assert_allclose(at(3.0), cube[0])
    for f in (0.9, 3.1):
        with pytest.raises(ValueError):
            images.plane_at(table, channels, f)
    sd, it = image_table(spark, cube[:1]), image_table(spark, cube[1:2])
    out = dense(images.feather(sd, it, 8, 8, 4.0, 2.0, alpha=1.5, dc_radius=2), (1, 8, 8), "value")[0][0]
    ky = np.fft.fftfreq(8)
    k2 = ky[:, None] ** 2 + ky[None, :] ** 2
    s2 = lambda w: (w / (2 * np.sqrt(2 * np.log(2)))) ** 2
    b, g = np.exp(-2 * np.pi**2 * s2(4.0) * k2), np.exp(-2 * np.pi**2 * s2(2.0) * k2)
    t = b * b / (b * b + g * g + 1e-12)
    yy, xx = np.indices((8, 8))
    t[np.hypot(yy, xx) <= 2] = 1
    f, d = np.fft.fft2(cube[1]), np.fft.fft2(cube[0])
    np.testing.assert_allclose(out, np.fft.ifft2(f + t * (1.5 * d - f)).real, atol=1e-9)
    assert images.halved(image_table(spark, cube), 3, 8, 8).count() == 3 * 4
    spot = dense(images.delta_source(spark, 5, 4, 7.0).selectExpr("0 as chan", "y", "x", "value"), (1, 5, 4), "value")[0][0]
    assert spot[2, 2] == pytest.approx(1 / 49) and np.count_nonzero(spot) == 1
