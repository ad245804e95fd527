"""Models as parts and solvers over tables: against the dense forms, finite differences and both Wolfe conditions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import fourier, measure
from skyloom.plans import iterative, models, solvers

from .test_engine import CELL, VIS, H, W, dense, image_table, operator, setup  # noqa: F401


def coefficient_table(spark, x):
    return image_table(spark, x).withColumnRenamed("chan", "k")


def coefficients(df, shape, name="value"):
    return dense(df.withColumnRenamed("k", "chan"), shape, name)[0]


def test_evaluation_equals_the_dense_form(spark, setup):  # noqa: F811
    x = np.random.default_rng(4).normal(size=(2, H, W))
    for kernel in ("join", "nufft"):
        op = operator(setup, kernel)
        obj = models.Objective(op, models.Cube([0, 1]), [models.Laplacian(1e-6)])
        point = obj.evaluate(obj.scratch.save(image_table(spark, x)))
        value, g = solvers.Problem(op, [0, 1], lambda_r=1e-6).loss_and_gradient(x)
        assert point.loss == pytest.approx(value, rel=1e-6)
        np.testing.assert_allclose(dense(point.table, x.shape, "gradient")[0], g, rtol=1e-6, atol=1e-5 * abs(g).max())
        obj.close()


def test_solvers_equal_the_dense_ones(spark, setup):  # noqa: F811
    op = operator(setup)
    dense_problem = solvers.Problem(op, [0, 1], lambda_r=1e-6)
    obj = models.Objective(op, models.Cube([0, 1]), [models.Laplacian(1e-6)])
    want = solvers.conjugate_gradient(dense_problem, np.zeros(dense_problem.shape), 3)
    got = dense(iterative.conjugate_gradient(obj, iterations=3), want.shape, "value")[0]
    np.testing.assert_allclose(got, want, atol=1e-6 * abs(want).max())
    # from the third iterate on, as from zero
    again = dense(iterative.conjugate_gradient(obj, image_table(spark, want), iterations=1), want.shape, "value")[0]
    np.testing.assert_allclose(again, solvers.conjugate_gradient(dense_problem, want, 1), atol=1e-6 * abs(want).max())
    obj.close()


def test_fista_equals_the_dense_form_and_stays_positive(spark, setup, monkeypatch):  # noqa: F811
    op = operator(setup)
    obj = models.Objective(op, models.Cube([0, 1]))
    problem = solvers.Problem(op, [0, 1])
    largest = iterative.lipschitz(obj, 4)
    assert largest == pytest.approx(solvers.lipschitz(problem, 8), rel=0.3)
    monkeypatch.setattr(iterative, "lipschitz", lambda obj: largest)
    monkeypatch.setattr(solvers, "lipschitz", lambda problem: largest)
    want = solvers.fista(problem, np.zeros((2, H, W)), 3)
    got = dense(iterative.fista(obj, iterations=3), want.shape, "value")[0]
    np.testing.assert_allclose(got, want, atol=1e-6 * abs(want).max())
    assert problem.loss_and_gradient(got)[0] < problem.loss_and_gradient(np.zeros_like(got))[0]
    start = image_table(spark, np.ones((2, H, W)))
    x = dense(iterative.fista(obj, start, iterations=2, positive=True), want.shape, "value")[0]
    assert x.min() >= 0
    obj.close()


def test_strong_wolfe_on_curves():
    for f, d in (
        (lambda t: (t - 3) ** 2, lambda t: 2 * (t - 3)),
        (lambda t: -t / (t * t + 2), lambda t: (t * t - 2) / (t * t + 2) ** 2),
        (lambda t: (t + 0.004) ** 5 - 2 * (t + 0.004) ** 4, lambda t: 5 * (t + 0.004) ** 4 - 8 * (t + 0.004) ** 3),
        (lambda t: math.exp(t) - 5 * t, lambda t: math.exp(t) - 5),
    ):
        for step in (1e-3, 0.1, 1.0, 10.0, 50.0):
            for c2 in (0.9, 0.1) if step < 50 else (0.9,):  # values near the end of a long search agree to all digits
                t, value, slope, _ = iterative.strong_wolfe(lambda t: (f(t), d(t), None), f(0), d(0), step, c2=c2)
                assert value <= f(0) + 1e-4 * t * d(0) and abs(slope) <= c2 * abs(d(0))
    assert iterative.strong_wolfe(lambda t: (t, 1.0, None), 0.0, -1.0, 1.0) is None  # the slope given is no descent


def test_lbfgs_steps_fulfil_both_wolfe_conditions(spark, setup):  # noqa: F811
    op, seen = operator(setup), []
    obj = models.Objective(op, models.Cube([0, 1]), [models.Negativity(0.3)])
    out = dense(iterative.lbfgs(obj, iterations=3, seen=seen), (2, H, W), "value")[0]
    assert len(seen) == 3
    for step, f0, slope0, f, slope in seen:
        assert f <= f0 + 1e-4 * step * slope0 and abs(slope) <= 0.9 * abs(slope0)
    # the same direction and steps as NumPy's two loops over whole vectors
    problem = solvers.Problem(op, [0, 1])

    def whole(x):
        value, g = problem.loss_and_gradient(x)
        below = np.maximum(-x, 0)
        return value + 0.3 * float((below**2).sum()), g - 0.6 * below

    dense_seen = []
    want = solvers.lbfgs(whole, np.zeros((2, H, W)), 3, seen=dense_seen)
    np.testing.assert_allclose([s[0] for s in seen], [s[0] for s in dense_seen], rtol=1e-5)
    np.testing.assert_allclose(out, want, atol=1e-5 * abs(want).max())
    obj.close()


def test_positive_lbfgs_recovers_the_sky(spark, setup):  # noqa: F811
    from .test_engine import numpy_forward

    v, channels, pb, grid, rows = setup
    truth = np.zeros((1, H, W))
    truth[0, 3, 2], truth[0, 2, 1] = 1.0, 0.5
    seen = numpy_forward(setup, np.concatenate([truth, truth]))
    data = spark.createDataFrame([(*r[:10], float(np.real(seen[r[0]])), float(-np.imag(seen[r[0]])), 1.0, r[13]) for r in rows if r[4] == 0], VIS)
    obj = models.Objective(measure.Measurement(data, channels, pb, grid, H, W, CELL), models.Cube([0]))
    before = obj.evaluate(obj.zeros()).loss
    table = iterative.solve(obj, positive=True, iterations=3)
    out = dense(table, (1, H, W), "value")[0]
    assert out.min() >= 0 and obj.evaluate(table).loss < 0.5 * before and np.unravel_index(out.argmax(), out.shape) == (0, 3, 2)
    with pytest.raises(ValueError):
        iterative.solve(obj, solver="other")
    obj.close()


def slope_at(obj, make, x, at, step=1e-4):
    up, down = x.copy(), x.copy()
    up[at] += step
    down[at] -= step
    return (obj.evaluate(make(up)).loss - obj.evaluate(make(down)).loss) / (2 * step)


def test_gradients_of_all_parts_equal_finite_differences(spark, setup):  # noqa: F811
    op, rng = operator(setup), np.random.default_rng(8)
    channels, make = setup[1], lambda x: coefficient_table(spark, x)
    dish = image_table(spark, rng.normal(size=(2, H, W)))
    lines = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.5), (1, 0, 0.0), (1, 1, 0.75)], "k int, chan int, value double")
    target = spark.createDataFrame([(b, 0.5 + b) for b in range(4)], "bin int, pk double")
    cases = [
        (models.with_continuum(lines, channels, 0, continuum_only=[1]), [models.SingleDish(dish, 2.0, 1e-4), models.Negativity(0.3), models.Laplacian(1e-5)], [models.Laplacian(1e-5), models.Ridge(0.1)], 3),
        (models.two_maps([0, 1], spark), [], [models.Spectrum(target, 3.0, 1)], 2),
        (models.GaussianMixture(channels, 1), [], [], 3),
        (models.PowerLaw(channels, 1.4e9), [], [], 2),
    ]
    for model, terms, priors, n in cases:
        obj = models.Objective(op, model, terms, priors)
        x = rng.normal(size=(n, H, W)) if n < 3 or terms else np.stack([rng.normal(size=(H, W)), rng.uniform(0, 1, (H, W)), rng.uniform(0.5, 2, (H, W))])
        g = coefficients(obj.evaluate(make(x)).table, x.shape, "gradient")
        for at in ((0, 2, 1), (n - 1, 4, 2)):
            d = slope_at(obj, make, x, at)
            assert g[at] == pytest.approx(d, rel=1e-4, abs=1e-4 * abs(g).max())
        obj.close()


def test_low_rank_equals_the_dense_form(spark, setup):  # noqa: F811
    op, x = operator(setup), np.random.default_rng(8).normal(size=(3, H, W))
    basis = np.array([[1.0, 0.5], [0.0, 0.75], [1.0, 1.0]])
    table = spark.createDataFrame([(k, c, float(basis[k, c])) for k in range(3) for c in range(2)], "k int, chan int, value double")
    obj = models.Objective(op, models.LowRank(table, 2, [1]), [models.Negativity(0.3)], [models.Laplacian(1e-6)], sigma_floor=1e-6)
    point = obj.evaluate(coefficient_table(spark, x))
    value, g = solvers.LowRankProblem(op, [0, 1], basis, lambda_r=1e-6, lambda_pos=0.3, n_line=2, continuum_only=[1]).loss_and_gradient(x)
    assert point.loss == pytest.approx(value, rel=1e-6)
    np.testing.assert_allclose(coefficients(point.table, x.shape, "gradient"), g, rtol=1e-6, atol=1e-6 * abs(g).max())
    obj.close()


def test_sweep_and_values_of_all_samples(spark, setup):  # noqa: F811
    op, made = operator(setup), []

    def make(lam):
        made.append(models.Objective(op, models.Cube([0, 1]), [models.Ridge(lam)]))
        return made[-1]

    out = iterative.sweep(make, [1e6, 1e4], solver="cg", iterations=1)
    size = [x.agg(F.sum(F.col("value") * F.col("value"))).first()[0] for x in out.values()]
    assert list(out) == [1e6, 1e4] and 0 < size[0] < size[1]  # less held, larger
    values = op.vis.select("vis_id", "chan", "beam", "re", "im")
    want, got = (dense(t, (2, H, W), "re")[0] for t in (op.adjoint(op.vis), op.adjoint_of(values)))
    np.testing.assert_allclose(got, want)
    for wrong in (values.limit(3), values.union(values.limit(1))):
        with pytest.raises(ValueError):
            op.adjoint_of(wrong)
    assert measure.dirty_noise(op, 5).where("value <> 0").count() == 2 * H * W
    for obj in made:
        obj.close()


def test_block_transform_equals_numpy(spark, monkeypatch):
    from skyloom.operators import nufft

    monkeypatch.setattr(fourier, "TILE", 5)
    monkeypatch.setattr(nufft, "TILE", 5)
    cube = np.random.default_rng(5).normal(size=(2, 13, 11))
    re, im = dense(fourier.fft(image_table(spark, cube), 13, 11), cube.shape, "re", "im")
    np.testing.assert_allclose(re + 1j * im, np.fft.fft2(cube), atol=1e-9)
    back = fourier.fft(fourier.fft(image_table(spark, cube), 13, 11), 13, 11, inverse=True)
    np.testing.assert_allclose(dense(back, cube.shape, "re")[0], cube, atol=1e-9)


def test_nothing_is_left_behind(spark, setup, tmp_path):  # noqa: F811
    import os

    obj = models.Objective(operator(setup), models.Cube([0, 1]))
    assert obj.spark.conf.get("spark.checkpoint.dir") in obj.scratch.path and os.path.isdir(obj.scratch.path)
    obj.close()
    assert not os.path.exists(obj.scratch.path)


class OnePixelEach(measure.Measurement):
    """Sample i of a channel and beam sees pixel i alone, times one complex number: losses and gradients are known by hand."""

    factor, n = 1.0, 1

    def _seen(self, good):
        i = F.pmod(F.pmod("vis_id", F.lit(self.n)), F.lit(self.height * self.width))
        return good.withColumns({"y": F.floor(i / self.width).cast("int"), "x": (i % self.width).cast("int")})

    def back(self, good):
        back = F.sum(self.factor.real * F.col("re") + self.factor.imag * F.col("im"))
        return self._seen(good).groupBy("chan", "y", "x").agg(back.alias("re"), F.lit(0.0).alias("im"))

    def normal(self, good, image):
        both = self._seen(good).join(image.select("chan", "y", "x", "value"), ["chan", "y", "x"])
        return both.groupBy("chan", "y", "x").agg(F.sum(abs(self.factor) ** 2 * F.col("iv") * F.col("value")).alias("value"))


LINES = [[1.0, 0.5, -0.25], [0.0, 0.75, 1.25]]


@pytest.mark.parametrize(
    "kind, n_vis, frequencies, first, factor, lambda_pos",
    [
        ("classic", 3, [1.40e9, 1.41e9], 0.1, 1.25 - 0.5j, 0.0),
        ("low rank", 4, [1.40e9, 1.41e9, 1.42e9], -0.5, 0.75 + 0.25j, 0.3),
        ("flat continuum", 4, [1.40e9, 1.41e9, 1.42e9], -0.5, 0.5 - 0.125j, 0.2),
        ("taylor continuum", 4, [1.40e9, 1.41e9, 1.42e9], -0.5, 0.25 + 0.5j, 0.2),
    ],
)
def test_models_on_known_operators(spark, kind, n_vis, frequencies, first, factor, lambda_pos):
    n_chan, h, w = len(frequencies), 3, 3
    data = np.arange(n_chan * 2 * n_vis, dtype=float).reshape(n_chan, 2, n_vis) + 1j
    rows = [(int((c * 2 + b) * n_vis + i), 0, b, 0, c, 0, 1, 1.0, 1.0, 0.0, float(data[c, b, i].real), 1.0, 2.0, False) for c in range(n_chan) for b in range(2) for i in range(n_vis)]
    channels = spark.createDataFrame([(c, f) for c, f in enumerate(frequencies)], "chan int, frequency double")
    pb = spark.createDataFrame([(b, y, x, 1.0) for b in range(2) for y in range(h) for x in range(w)], "beam int, y int, x int, value double")
    op = OnePixelEach(spark.createDataFrame(rows, VIS), channels, pb, pb.selectExpr("beam", "y", "x", "0.0d as gx", "0.0d as gy"), h, w, 1.0)
    op.factor, op.n = factor, n_vis
    basis = np.array(LINES)
    if kind == "flat continuum":
        basis = np.vstack([basis, np.ones(3)])
    if kind == "taylor continuum":
        basis = np.vstack([basis, np.ones(3), (np.array(frequencies) - 1.41e9) / 1.41e9])
    lines = spark.createDataFrame([(k, c, v) for k, row in enumerate(LINES) for c, v in enumerate(row)], "k int, chan int, value double")
    model = {
        "classic": lambda: models.Cube(range(n_chan)),
        "low rank": lambda: models.LowRank(lines),
        "flat continuum": lambda: models.with_continuum(lines, channels),
        "taylor continuum": lambda: models.with_continuum(lines, channels, 1, 1.41e9),
    }[kind]()
    basis = np.eye(n_chan) if kind == "classic" else basis
    x = np.linspace(first, 1.0, len(basis) * h * w).reshape(len(basis), h, w)
    cube = np.einsum("kc,kyx->cyx", basis, x)
    flat, seen = cube.reshape(n_chan, -1), np.arange(n_vis) % (h * w)
    off = flat[:, seen][:, None, :] * factor - data.conj()
    slope = np.zeros_like(flat)
    slope[:, seen] = (np.conj(factor) * off).real.sum(1) / 4
    below = np.maximum(-cube, 0)
    loss = 0.5 * (abs(off) ** 2).sum() / 4 + lambda_pos * (below**2).sum()
    gradient = np.einsum("kc,cyx->kyx", basis, slope.reshape(cube.shape) - 2 * lambda_pos * below)

    obj = models.Objective(op, model, [models.Negativity(lambda_pos)] if lambda_pos else [])
    table = image_table(spark, x) if kind == "classic" else coefficient_table(spark, x)
    point = obj.evaluate(table)
    assert point.loss == pytest.approx(loss, rel=1e-6)
    got = dense(point.table, x.shape, "gradient")[0] if kind == "classic" else coefficients(point.table, x.shape, "gradient")
    np.testing.assert_allclose(got, gradient, rtol=1e-6, atol=1e-5)
    obj.close()
