"""What moves and what one task holds: these fail where a step would grow with the whole input."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom import fixtures, queries
from skyloom.operators import ingest, measure, nufft, spectral
from skyloom.plans import iterative, models, solvers

from .test_engine import CELL, H, W, image_table, operator, setup  # noqa: F401


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_maps_are_read_at_once(spark, setup):  # noqa: F811
    """Samples go to tiles once for all maps and their channels are made in place; samples of one id add up."""
    seen = operator(setup).vis
    seen = seen.union(seen.where("vis_id = 7"))
    coef = image_table(spark, np.random.default_rng(2).normal(size=(3, H, W))).withColumnRenamed("chan", "k").where("k < 2 or x > 0")
    basis = spark.sql("select * from values (0, 0, 0.5d), (1, 0, -2d), (2, 1, 1.5d), (1, 1, 3d), (9, 4, 1d) as t(k, chan, value)")
    by_grid, by_sum = (spectral.mixed_visibilities(seen, coef, basis, H, W, CELL, kernel, 14) for kernel in ("nufft", "join"))
    assert "hashpartitioning(vis_id" not in plan_of(by_grid)
    got, want = ({(r.vis_id, r.chan): (r.re, r.im) for r in t.collect()} for t in (by_grid, by_sum))
    assert got.keys() == want.keys() and len(got) == by_grid.count() == 120
    for at in want:
        assert got[at] == pytest.approx(want[at], abs=1e-7)


def test_screens_move_the_image_once(spark, setup):  # noqa: F811
    """Planes of more bins than a task makes at a time are made in tasks; no row a pixel and bin is planned."""
    seen = operator(setup).vis.where("not flag").withColumn("ww", 3.0e3 * F.col("uu") + F.col("vis_id"))
    image = image_table(spark, np.random.default_rng(3).normal(size=(2, H, W)))
    by_grid, by_sum = (spectral.w_stacked(seen, image, H, W, CELL, 31, ("beam", "chan"), kernel, 14) for kernel in ("nufft", "join"))
    assert "COS(" not in plan_of(by_grid).upper()
    got, want = ({r.vis_id: (r.m_re, r.m_im) for r in t.collect()} for t in (by_grid, by_sum))
    assert got.keys() == want.keys()
    for at in want:
        assert got[at] == pytest.approx(want[at], abs=1e-7)


@pytest.fixture()
def uncoalesced(spark):
    changed = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in changed}
    for k in changed:
        spark.conf.set(k, changed[k])
    yield spark
    for k in changed:
        spark.conf.set(k, before[k])


def test_no_task_numbers_all_samples(uncoalesced, tmp_path):
    """Ids equal those of the SQL, with keys that are far apart, below zero, repeated and missing, and many tasks give them."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    order = "case when i % 97 = 0 then null when i % 2 = 0 then i*37 - 20000 else i*1000003 end"
    con.execute(f"create table lineitem as select cast({order} as bigint) as l_orderkey, cast(case when i % 89 = 0 then null else i % 7 + 1 end as int) as l_linenumber, cast(i*7 % 200 as bigint) as l_partkey, cast(i % 10 as bigint) as l_suppkey, timestamp '1995-01-01' + to_days(cast(i as int)) as l_shipdate, i*1.0e0 as l_extendedprice, 1.0e0 as l_quantity, 0.05e0 as l_discount, 0.02e0 as l_tax, 'R' as l_returnflag, 'O' as l_linestatus from range(3000) t(i)")
    con.execute("insert into lineitem select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice + 0.5e0, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus from lineitem where l_suppkey = 3")
    con.execute(f"copy lineitem to '{tmp_path}/lineitem.parquet' (format parquet)")
    want = con.execute(fixtures.oracle("select p1_re, vis_id from fx_vis")).fetchall()
    got = fixtures.view(uncoalesced, str(tmp_path), "fx_vis").select("p1_re", "vis_id", F.spark_partition_id().alias("task")).collect()
    assert {r.p1_re: r.vis_id for r in got} == dict(want) and len(got) == len(want) == 3300
    assert len({r.task for r in got}) > 4


def test_places_by_ranges(uncoalesced):
    rng = np.random.default_rng(5)
    rows = [(None if i % 50 == 0 else int(rng.integers(4)), int(n)) for i, n in enumerate(rng.permutation(5000) * 3 - 4000)]
    t = ingest.numbered(uncoalesced.createDataFrame(rows, "beam int, vis_id long"), "beam", "vis_id", 6)
    got = t.select("beam", "vis_id", "place", F.spark_partition_id().alias("task")).collect()
    assert [(r.beam, r.vis_id) for r in sorted(got, key=lambda r: r.place)] == sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert sorted(r.place for r in got) == list(range(1, 5001)) and len({r.task for r in got}) > 4


@pytest.mark.parametrize("most", [1 << 20, 4])
def test_samples_are_not_dealt_by_plane(uncoalesced, setup, monkeypatch, most):  # noqa: F811
    """Planes go to the samples, unless they are too many together; both ways give the same, and samples without a plane go."""
    spark, op = uncoalesced, operator(setup)
    image = image_table(spark, np.random.default_rng(4).normal(size=(1, H, W)))
    maps = image.withColumnRenamed("chan", "k")
    basis = spark.sql("select * from values (0, 0, 0.5d), (0, 1, 2d) as t(k, chan, value)")
    good = op.vis.where("not flag").withColumn("iv", F.lit(1.0))
    made = lambda: {
        "degrid": measure.degrid(good, image, H, W, CELL),
        "normal": operator(setup).normal(good, image),
        "w_stacked": spectral.w_stacked(good, image, H, W, CELL, 3, ("beam", "chan")),
        "mixed": spectral.mixed_visibilities(good, maps, basis, H, W, CELL),
    }
    rows = lambda t: {tuple(r[c] for c in t.columns if c not in ("m_re", "m_im", "re", "im", "value")): [r[c] for c in t.columns if c in ("m_re", "m_im", "re", "im", "value")] for r in t.collect()}
    want = {name: rows(t) for name, t in made().items()}
    monkeypatch.setattr(measure, "SENT_PIXELS", most, raising=False)
    for name, t in made().items():
        plan, got = plan_of(t), rows(t)
        assert got.keys() == want[name].keys() and len(got) == {"degrid": 28, "normal": H * W, "w_stacked": 28, "mixed": 112}[name]
        for at in got:
            assert got[at] == pytest.approx(want[name][at], rel=1e-9, abs=1e-9)
        if name != "normal":  # whose sums by pixel are dealt by their plane too
            assert any(f"hashpartitioning({k}#" in plan for k in ("chan", "k")) == (most == 4), name


def test_tall_columns_are_transformed_a_few_at_a_time(uncoalesced, monkeypatch):
    """No task of the adjoint holds more of a plane than COLUMN_PIXELS, and results don't move to meet the wanted pixels."""
    rng, (h, w, n) = np.random.default_rng(11), (150, 20, 300)
    monkeypatch.setattr(nufft, "COLUMN_PIXELS", 3 * h)
    plain = nufft._to_pixels

    def watched(size, *how):
        run = plain(size, *how)

        def change(block):
            assert size != h or len(block) <= 3
            return run(block)

        return change

    monkeypatch.setattr(nufft, "_to_pixels", watched)
    u, v, d = rng.uniform(-3, 3, n), rng.uniform(-3, 3, n), rng.normal(size=(n, 2)) @ [1, 1j]
    d[200:] = 0  # nothing is seen in the second plane
    seen = uncoalesced.createDataFrame([(int(i >= 200), None, float(u[i]), float(v[i]), float(d[i].real), float(d[i].imag)) for i in range(n)], "chan int, beam int, ur double, vr double, re double, im double")
    wanted = [(int(p) // w, int(p) % w) for p in rng.choice(h * w, 1000, replace=False)]
    pixels = uncoalesced.createDataFrame([*wanted, *wanted[:9], (h, 1), (3, -1), (None, 2)], "y int, x int")
    t = measure.grid_adjoint(seen, pixels, h, w, CELL, kernel="nufft")
    got = t.collect()
    assert "Semi" not in plan_of(t) and len(got) == 2000 and {(r.y, r.x) for r in got} == set(wanted)
    want = CELL**2 * np.exp(1j * np.outer(np.arange(h) - h // 2, v)) @ (d[:, None] * np.exp(-1j * np.outer(u, np.arange(w) - w // 2)))
    for r in got:
        assert complex(r.re, r.im) == pytest.approx(0 if r.chan else want[r.y, r.x], abs=1e-5 * abs(want).max())
    assert nufft.adjoint(seen.where("chan = 0"), h, w, CELL).count() == h * w


@pytest.mark.parametrize("most", [1 << 20, 4])
def test_maps_are_summed_in_a_row_a_sample(uncoalesced, monkeypatch, most):
    """Both ways to mix small maps: ids that are repeated over batches of two rows add up, unknown angles give nulls."""
    monkeypatch.setattr(measure, "SENT_PIXELS", most)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = uncoalesced.conf.get(batch)
    uncoalesced.conf.set(batch, "2")
    try:
        rng = np.random.default_rng(12)
        maps, w, at = rng.normal(size=(3, H, W)), rng.normal(size=(3, 4)), rng.uniform(-3, 3, (60, 2))
        ids = [i % 13 for i in range(57)] + [20, 21, 21]
        rows = [(n, *((None, None) if i in (57, 58) else at[i].tolist())) for i, n in enumerate(ids)]
        coef = image_table(uncoalesced, maps).withColumnRenamed("chan", "k").where("k < 2 or x > 0")
        basis = uncoalesced.createDataFrame([(k, c, float(w[k, c])) for k in range(3) for c in range(4)] + [(9, 7, 1.0)], "k int, chan int, value double")
        t = spectral.mixed_visibilities(uncoalesced.createDataFrame(rows, "vis_id long, ur double, vr double"), coef, basis, H, W, CELL)
        got = {(r.vis_id, r.chan): (r.re, r.im) for r in t.collect()}
        assert "hashpartitioning(vis_id#" in plan_of(t) and "chan#" not in "".join(p for p in plan_of(t).split("\n") if "hashpartitioning" in p and "vis_id" in p)
    finally:
        uncoalesced.conf.set(batch, before)
    maps[2, :, 0] = 0
    want = np.zeros((22, 4), complex)
    for n, (u, v) in zip(ids[:57] + [21], [*at[:57], at[59]]):
        seen = np.exp(-1j * v * (np.arange(H) - H // 2)) @ maps @ np.exp(1j * u * (np.arange(W) - W // 2))
        want[n] += CELL**2 * (seen if seen.ndim == 1 else seen.ravel()) @ w
    assert got.keys() == {(n, c) for n in set(ids) for c in range(4)}
    for (n, c), value in got.items():
        assert value == (None, None) if n == 20 else complex(*value) == pytest.approx(want[n, c], rel=1e-9, abs=1e-9)


def test_pixels_outside_their_plane_are_not_sent(spark):
    with pytest.raises(ValueError):
        measure.sent_planes(spark.createDataFrame([(0, H, 0, 1.0)], "k int, y int, x int, value double"), H, W, ["k"])


@pytest.mark.parametrize("most", [1 << 20, 4])
def test_an_iteration_is_one_pass_and_moves_no_sample(uncoalesced, setup, monkeypatch, most):  # noqa: F811
    """Three iterations read the samples three times, where they are; planes too many to send are joined as before."""
    monkeypatch.setattr(measure, "SENT_PIXELS", most)
    passes, normal = [], measure.Measurement.normal
    monkeypatch.setattr(measure.Measurement, "normal", lambda op, good, image: passes.append(normal(op, good, image)) or passes[-1])
    obj = models.Objective(operator(setup), models.Cube([0, 1]))
    try:
        got = {(r.chan, r.y, r.x): r.value for r in iterative.conjugate_gradient(obj, iterations=3, tol=0.0).collect()}
        assert len(passes) == 3
        assert ("vis_id" in plan_of(passes[0])) == (most == 4)
    finally:
        obj.close()
    problem = solvers.Problem(operator(setup), [0, 1])
    want = solvers.conjugate_gradient(problem, np.zeros(problem.shape), iterations=3, tol=0.0)
    assert len(got) == want.size
    for at, value in got.items():
        assert value == pytest.approx(want[at], rel=1e-9, abs=1e-12)


def test_sums_in_tasks_leave_out_what_is_unknown(spark):
    """As sums in SQL do: samples without an angle, a value or a plane add nothing."""
    rows = [(0, 0, 0.3, -0.2, 1.0, 2.0, 0.5), (0, 0, None, 0.1, 1.0, 1.0, 1.0), (0, 0, 0.1, 0.1, None, 1.0, None), (0, None, 0.1, 0.1, 1.0, 1.0, 1.0), (1, 5, 0.2, 0.4, 3.0, 1.0, 2.0)]
    good = spark.createDataFrame(rows, "chan int, beam int, ur double, vr double, re double, im double, iv double")
    seen = lambda u, v: np.exp(1j * (u * (np.arange(W) - W // 2) - v * (np.arange(H) - H // 2)[:, None]))
    plane = np.random.default_rng(13).normal(size=(H, W))
    model = 0.5 * CELL**2 * (plane * seen(0.3, -0.2)).sum()
    wants = [(None, {(0, 0): (1 + 2j) * seen(0.3, -0.2).conj(), (1, 5): (3 + 1j) * seen(0.2, 0.4).conj()}), ({(0, 0): plane, (2, 0): plane}, {(0, 0): model * seen(0.3, -0.2).conj()})]
    for planes, want in wants:
        rows = measure.summed_in_tasks(good, H, W, CELL, planes).groupBy("chan", "beam", "y", "x").agg(F.sum("re").alias("re"), F.sum("im").alias("im")).collect()
        assert {(r.chan, r.beam) for r in rows} == want.keys() and len(rows) == len(want) * H * W
        for r in rows:
            assert complex(r.re, r.im) == pytest.approx(CELL**2 * want[r.chan, r.beam][r.y, r.x], rel=1e-9)
    with pytest.raises(ValueError):
        measure.summed_in_tasks(good, 65, 64, CELL)


SMALL = "/root/testdata/sf0.01"


def metrics_of(spark, run):
    """The metrics of each task of ``run``."""
    store = spark.sparkContext._jsc.sc().statusStore()
    jobs = lambda: {j.jobId(): j for j in (store.jobsList(None).apply(i) for i in range(store.jobsList(None).size()))}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = set(jobs())
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = {job.stageIds().apply(i) for n, job in jobs().items() if n not in before for i in range(job.stageIds().size())}
    for stage in stages:
        tasks = store.taskList(stage, 0, 100000)
        for i in range(tasks.size()):
            m = tasks.apply(i).taskMetrics()
            if m.isDefined():
                yield m.get()


def most_read(spark, run):
    """The records that the busiest task of ``run`` reads from shuffles."""
    return max(m.shuffleReadMetrics().recordsRead() for m in metrics_of(spark, run))


def written(spark, run):
    """The records that all tasks of ``run`` write to shuffles."""
    return sum(m.shuffleWriteMetrics().recordsWritten() for m in metrics_of(spark, run))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_no_row_a_sample_map_and_channel_moves(uncoalesced):
    """Of q74_all's 60,000 samples, 34,117 of them good, only these go anywhere: to get ids, and to their id's place."""
    assert 90000 < written(uncoalesced, lambda: queries.QUERIES["q74_all"](uncoalesced, SMALL).write.format("noop").mode("overwrite").save()) < 110000


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
@pytest.mark.parametrize("name", ["q83_solver", "q88_low_rank", "q03", "q83", "q83_all", "q83_joint", "q77", "q77_planes", "q40", "q40_nufft", "q62_all"])
def test_no_task_reads_half_of_the_samples(uncoalesced, name):
    """60,000 samples in 15 ranges of keys and 8 partitions, in any job of the query."""
    got = most_read(uncoalesced, lambda: queries.QUERIES[name](uncoalesced, SMALL).write.format("noop").mode("overwrite").save())
    assert 1000 < got < 30000
