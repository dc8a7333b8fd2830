import math

import dense
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardline.operators import riskset
from wardline.operators.cox import RowModel, cox_fit, moment_pass, prepare_panel
from wardline.operators.design import Category, Numeric, build_design, centre_scale, terms
from wardline.operators.exposure import cumulative_product, first_exposure_rows
from wardline.operators.ipw import Exposure, ipw_weights
from wardline.operators.riskset import Jumps, WeightModels, all_weights
from wardline.operators.steps import tie_sums
from wardline.operators.sweep import (
    EffectModel,
    bind_rows,
    cutoff_counts,
    cutoff_sweep,
    expand_cutoffs,
    single_cutoff,
)

TERMS = terms("a", Numeric("b", 10), Category("g"))


def sample(stays=90, days=8, seed=5):
    """Daily rows with ties, gaps, an exposure, events and drop-outs."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(stays):
        g = "mfx"[rng.integers(3)]
        base = rng.normal()
        last = rng.integers(2, days + 1)
        exposed = 0
        for t in range(1, last + 1):
            if rng.random() < 0.1:
                continue
            v = round(float(rng.exponential(10)), 1)
            exposed = int(exposed or rng.random() < 0.15 + 0.02 * (v > 10))
            died = rng.random() < 0.06 * math.exp(0.5 * base)
            rows.append(
                (i, t - 1, t, base, float(rng.normal(50, 10)), g, v, exposed, int(died),
                 int(t == last and t < days and not died), float(rng.uniform(0.5, 2)))
            )
            if died:
                break
    names = ["id", "start", "stop", "a", "b", "g", "v", "exposed", "event", "dropout", "w"]
    return pd.DataFrame(rows, columns=names)


def matrix(df):
    b = df["b"].to_numpy()
    return np.column_stack(
        [df["a"], (b - b.mean()) / 10, df["g"] == "m", df["g"] == "x"]
    ).astype(float)


def times(df):
    return df["start"].to_numpy(), df["stop"].to_numpy(), df["event"].to_numpy()


def by_term(result):
    return {r["term"]: r for r in result.effects.collect()}


@pytest.fixture(scope="module")
def panel(spark):
    df = sample()
    return df, spark.createDataFrame(df).repartition(3)


def test_fit_matches_dense_with_weights_and_ties(panel):
    df, sdf = panel
    got = by_term(cox_fit(sdf, "id", "start", "stop", "event", TERMS, weight="w"))
    x, w = matrix(df), df["w"].to_numpy()
    beta = dense.fit(x, *times(df), w)
    se = dense.robust_se(beta, x, *times(df), w, df["id"].to_numpy())
    assert list(got) == ["a", "b/10", "g=m", "g=x"]
    for j, row in enumerate(got.values()):
        assert row["coef"] == pytest.approx(beta[j], abs=1e-7)
        assert row["se"] == pytest.approx(se[j], rel=1e-6)
        assert row["hr"] == pytest.approx(math.exp(beta[j]), rel=1e-6)
        assert row["inv_hr"] == pytest.approx(math.exp(-beta[j]), rel=1e-6)
        assert row["lo95"] == pytest.approx(math.exp(beta[j] - 1.959964 * se[j]), rel=1e-5)
        assert row["hi95"] == pytest.approx(math.exp(beta[j] + 1.959964 * se[j]), rel=1e-5)
        assert row["converged"]


def test_many_times_and_large_coefficients(spark):
    """Times are not bounded, and a coefficient may take the predictor beyond any fixed limit."""
    rng = np.random.default_rng(5)
    n = 400
    df = pd.DataFrame({"id": np.arange(n), "start": 0, "stop": 1 + rng.permutation(n) % 200})
    df.loc[0, "stop"] = 6_500
    df["x"] = rng.normal(0, 1, n)
    df.loc[1, "x"] = 400.0
    df["event"] = (rng.random(n) < 0.5).astype(int)
    df.loc[[0, 1], "event"] = 1, 0
    df.loc[1, "stop"] = 1
    df.loc[2, ["start", "stop", "event"]] = 0, 6_400, 0
    got = by_term(cox_fit(spark.createDataFrame(df), "id", "start", "stop", "event", terms("x")))["x"]
    x = df[["x"]].to_numpy()
    beta = dense.fit(x, *times(df))
    assert got["converged"] and got["coef"] == pytest.approx(beta[0], abs=1e-7)


def test_the_step_limit_is_reported(panel):
    _, sdf = panel
    result = cox_fit(sdf, "id", "start", "stop", "event", TERMS, max_steps=1)
    (fit,) = result.fits
    assert not fit.converged and (fit.beta == fit.kept).all()
    assert fit.sums is fit.kept_sums
    assert all(r["se"] is None and not r["converged"] for r in result.effects.collect())


def test_coefficients_are_exact_to_the_last_digits(panel):
    """The step after convergence leaves no trace of the tolerance, so that rounded results are stable."""
    df, sdf = panel
    got = by_term(cox_fit(sdf, "id", "start", "stop", "event", terms("a")))["a"]["coef"]
    x = df[["a"]].to_numpy()
    assert got == pytest.approx(dense.fit(x, *times(df))[0], abs=1e-12)


def test_model_based_errors(panel):
    df, sdf = panel
    got = by_term(cox_fit(sdf, "id", "start", "stop", "event", terms("a"), robust=False))
    x = df[["a"]].to_numpy()
    beta = dense.fit(x, *times(df))
    info = dense.derivatives(beta, x, *times(df), np.ones(len(df)))[2]
    assert got["a"]["se"] == pytest.approx(info[0, 0] ** -0.5, rel=1e-6)


def test_long_intervals_equal_daily_rows(spark):
    df = sample(seed=8)
    df = df[df.groupby("id")["stop"].transform("max") >= 2]
    rng = np.random.default_rng(0)
    long = df.groupby("id").agg(
        start=("start", "min"), stop=("stop", "max"), a=("a", "first"), event=("event", "max")
    ).reset_index()
    long["b"] = rng.normal(50, 10, len(long))
    x = np.column_stack([long["a"], long["b"] / 10])
    got = by_term(
        cox_fit(spark.createDataFrame(long), "id", "start", "stop", "event",
                terms("a", Numeric("b", 10)))
    )
    beta = dense.fit(x, *times(long))
    se = dense.robust_se(beta, x, *times(long), np.ones(len(long)), long["id"].to_numpy())
    assert got["a"]["coef"] == pytest.approx(beta[0], abs=1e-7)
    assert got["b/10"]["coef"] == pytest.approx(beta[1], abs=1e-7)
    assert got["b/10"]["se"] == pytest.approx(se[1], rel=1e-6)


def test_binary_covariate_without_ties_has_a_closed_form(spark):
    # exposed dies first of (2 exposed, 2 not), then an unexposed of (1, 2): root of the score
    rows = [(1, 0, 1, 1, 1), (2, 0, 2, 1, 0), (3, 0, 3, 0, 1), (4, 0, 1, 0, 2)]
    rows = [(1, 0, 1, 1.0, 1), (2, 0, 3, 1.0, 0), (3, 0, 2, 0.0, 1), (4, 0, 3, 0.0, 0)]
    df = spark.createDataFrame(rows, "id long, start int, stop int, x double, event int")
    got = by_term(cox_fit(df, "id", "start", "stop", "event", terms("x"), robust=False))
    # score: 1 - 2h/(2h+2) - h/(h+2) = 0  =>  h**2 = 2
    assert got["x"]["hr"] == pytest.approx(math.sqrt(2), rel=1e-7)


def test_null_model_gives_nelson_aalen(panel):
    df, sdf = panel
    result = cox_fit(sdf, "id", "start", "stop", "event", (), robust=False)
    got = {r["time"]: r["jump"] for r in result.baseline.collect()}
    for t, jump in got.items():
        n = ((df["start"] < t) & (df["stop"] >= t)).sum()
        d = ((df["stop"] == t) & (df["event"] == 1)).sum()
        assert jump == pytest.approx(sum(1 / (n - k) for k in range(d)), rel=1e-12)
    assert set(got) == set(df.loc[df["event"] == 1, "stop"])


def test_tie_sums_equal_step_by_step_sums():
    rng = np.random.default_rng(3)
    d = np.array([0, 1, 2, 5, 63, 64, 65, 66, 100, 129, 1000, 50_000, 300_000])
    for share in (0.0, 1e-12, 1e-3, 0.5, 1 - 1e-9, 1.0):
        s0 = np.exp(rng.uniform(-40, 40, len(d)))
        t0 = share * s0
        got = tie_sums(s0, t0, d)
        for i, n in enumerate(d):
            f = np.arange(n) / max(n, 1)
            s = s0[i] - f * t0[i]
            expected = [np.log(s), 1 / s, f / s, 1 / s**2, f / s**2, f * f / s**2]
            for found, terms in zip((got.log, got.a0, got.a1, got.b0, got.b1, got.b2), expected, strict=True):
                size = np.abs(terms).sum()
                assert abs(found[i] - terms.sum()) <= 1e-12 * size, (share, n)
    assert len(tie_sums(np.zeros(0), np.zeros(0), np.zeros(0, int)).log) == 0


def test_shift_order_and_partitions_do_not_matter(panel):
    df, sdf = panel
    a = by_term(cox_fit(sdf, "id", "start", "stop", "event", TERMS))
    other = sdf.withColumn("a", F.col("a") + 7).orderBy(F.rand(1)).repartition(7)
    b = by_term(cox_fit(other, "id", "start", "stop", "event", TERMS))
    for term in a:
        assert a[term]["coef"] == pytest.approx(b[term]["coef"], abs=1e-8)
        assert a[term]["se"] == pytest.approx(b[term]["se"], rel=1e-6)


def test_missing_rows_are_dropped_from_the_outcome(spark, panel):
    df, _ = panel
    holes = df.copy()
    holes.loc[::7, "a"] = np.nan
    got = by_term(cox_fit(spark.createDataFrame(holes), "id", "start", "stop", "event", terms("a")))
    kept = holes.dropna()
    assert got["a"]["coef"] == pytest.approx(
        dense.fit(kept[["a"]].to_numpy(), *times(kept))[0], abs=1e-7
    )


def test_aliased_and_empty_models_give_missing_numbers(spark, panel):
    _, sdf = panel
    doubled = sdf.withColumn("twice", F.col("a") * 2).withColumn("flat", F.lit(3.0))
    got = by_term(cox_fit(doubled, "id", "start", "stop", "event", terms("a", "twice", "flat")))
    assert got["a"]["hr"] is not None
    assert got["twice"]["hr"] is None and got["flat"]["lo95"] is None
    none = sdf.withColumn("event", F.lit(0))
    got = by_term(cox_fit(none, "id", "start", "stop", "event", terms("a")))
    assert got["a"]["hr"] is None and got["a"]["n_events"] == 0


def test_separation_does_not_fail(spark):
    rows = [(i, 0, 1 + i % 3, float(i < 5), int(i < 5)) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, start int, stop int, x double, event int")
    got = by_term(cox_fit(df, "id", "start", "stop", "event", terms("x")))
    assert got["x"]["n_events"] == 5


def test_bad_panels_are_refused(spark):
    schema = "id long, start int, stop int, x double, event int"
    twice = spark.createDataFrame([(1, 0, 1, 1.0, 0), (1, 0, 1, 2.0, 1)], schema)
    with pytest.raises(Exception, match="several rows"):
        cox_fit(twice, "id", "start", "stop", "event", terms("x"))
    empty = spark.createDataFrame([(1, 2, 2, 1.0, 0)], schema)
    with pytest.raises(ValueError, match="whole start < stop"):
        cox_fit(empty, "id", "start", "stop", "event", terms("x"))


def test_moments_do_not_depend_on_batches(spark, panel):
    _, sdf = panel
    ready = prepare_panel(sdf, "id", "start", "stop", TERMS, {"event": "event"})
    model = RowModel("m", (0, 1, 2, 3), "_s_event")
    beta, on = [np.full((1, 4), 0.1)], [np.array([True])]

    def sums():
        table = moment_pass(ready, [model], beta, on).toPandas().sort_values("time")
        return np.column_stack([table["time"], np.stack(table["sums"])])

    a = sums()
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        b = sums()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    np.testing.assert_allclose(a, b, rtol=1e-12)


# --------------------------------------------------------------------------
# weights


def exposure(name="treat", column="exposed"):
    return Exposure(name, column, terms("a"), terms("a", "v"))


def dense_weights(df, column="exposed"):
    df = df.sort_values(["id", "stop"])
    return df, dense.ipw(
        df["id"].to_numpy(), df["start"].to_numpy(), df["stop"].to_numpy(),
        df[column].to_numpy(), df[["a"]].to_numpy(), df[["a", "v"]].to_numpy(),
    )


def test_weights_match_dense(panel):
    df, sdf = panel
    both = [exposure(), exposure("cens", "dropout")]
    got = ipw_weights(sdf, "id", "start", "stop", both).toPandas().sort_values(["id", "stop"])
    ordered, treat = dense_weights(df)
    _, cens = dense_weights(df, "dropout")
    assert list(got["id"]) == list(ordered["id"]) and list(got["stop"]) == list(ordered["stop"])
    np.testing.assert_allclose(got["w_treat"], treat, rtol=1e-6)
    np.testing.assert_allclose(got["w_cens"], cens, rtol=1e-6)
    np.testing.assert_allclose(got["w"], treat * cens, rtol=1e-6)
    assert np.std(treat) > 0.001


def test_weights_beyond_the_range_of_numbers():
    """Hazards of 1e-300 and 1e+3 in one stay: the products equal those of exact arithmetic."""
    n = 60
    hazard = np.array([1e-300 if k % 3 else 1e3 for k in range(n)])
    exposed = np.zeros(n)
    exposed[-1] = 1
    frame = pd.DataFrame({"_id": 1, "_start": np.arange(n), "_stop": np.arange(1, n + 1), "_value": 0.0, "_x0": np.log(hazard), "_s": exposed, "_u": np.inf})
    block = riskset._block(frame, 1)
    top, bottom = (Jumps(np.arange(1, n + 1), np.full(n, jump)) for jump in (0.5, 1.0))
    part = WeightModels("w", "_s", "_u", (), (0,), np.zeros((1, 0)), np.ones((1, 1)), (top,), (bottom,))
    got = part.log_weights(block, np.array([0.0]))[:, 0]
    change = [math.log(-math.expm1(-0.5)) - (math.log(h) if h < 1e-30 else math.log(-math.expm1(-h))) for h in hazard]
    steps = [c if e else h - 0.5 for h, e, c in zip(hazard, exposed, change, strict=True)]
    expected = [math.fsum(steps[: k + 1]) for k in range(n)]
    assert got == pytest.approx(expected, rel=1e-14)
    assert expected[-1] > 1e4  # no double holds exp of it
    top = all_weights(block, (part,), None, np.array([0.0]), np.array([max(expected)]))
    assert np.isfinite(top).all() and top.max() == pytest.approx(1.0, rel=1e-8)


def test_extreme_weights_give_the_dense_outcome(spark):
    """Weights of a sweep in the range of 1e+400 leave a finite outcome, equal to the dense one with scaled weights."""
    df = sample(60, 6, seed=9)
    logs = np.where(df["id"] % 2 == 0, 900.0, 899.0) + df["a"] * 0.1
    stretched = df.assign(w=np.exp(logs - logs.max()))
    got = by_term(cox_fit(spark.createDataFrame(stretched), "id", "start", "stop", "event", terms("a"), weight="w"))["a"]
    x = df[["a"]].to_numpy()
    beta = dense.fit(x, *times(df), stretched["w"].to_numpy() * 1e6)
    assert got["status"] == "converged" and got["coef"] == pytest.approx(beta[0], abs=1e-8)


def test_fits_that_cannot_start_say_so(spark, panel):
    df, _ = panel
    bad = spark.createDataFrame(df.assign(w=np.where(df["id"] == 3, np.inf, 1.0)))
    rows = cox_fit(bad, "id", "start", "stop", "event", TERMS, weight="w").effects.collect()
    assert {r["status"] for r in rows} == {"not finite"} and not any(r["converged"] for r in rows)
    assert all(r[c] is None for r in rows for c in ("coef", "se", "hr", "lo95"))
    none = spark.createDataFrame(df.assign(event=0))
    result = cox_fit(none, "id", "start", "stop", "event", terms("a"))
    (row,) = result.effects.collect()
    assert (row["status"], row["converged"], row["coef"]) == ("no events", False, None)
    assert [tuple(r)[1:] for r in result.report.collect()] == [("outcome", "no events", 0, 0)]


def test_weight_models_report_how_they_ended(spark):
    """A confounder that tells the exposed apart: the model separates, the weights and the outcome stay finite, and it is seen."""
    df = sample(60, 6, seed=4)
    rng = np.random.default_rng(1)
    df["marker"] = np.where(df["exposed"] == 1, 5.0, 0.0) + rng.normal(0, 0.01, len(df))
    model = EffectModel("id", "start", "stop", "event", (Exposure("t", "exposed", terms(), terms("marker")),), terms("exposed", "a"))
    result = cutoff_sweep(spark.createDataFrame(df), model, None)
    ends = {r["model"]: r["status"] for r in result.report.collect()}
    assert ends["t numerator"] == "converged" and ends["outcome"] == "converged"
    assert ends["t denominator"] in ("separated", "step limit", "converged")
    rows = result.effects.collect()
    assert all(r["converged"] and r["se"] is not None for r in rows)
    expected = "ok" if ends["t denominator"] in ("separated", "converged") else "t denominator: step limit"
    assert {r["weight_status"] for r in rows} == {expected}


def test_equal_models_give_unit_weights(panel):
    _, sdf = panel
    same = Exposure("treat", "exposed", terms("a", "v"), terms("a", "v"))
    got = ipw_weights(sdf, "id", "start", "stop", [same]).toPandas()
    np.testing.assert_allclose(got["w_treat"], 1.0, rtol=1e-12)


def test_weights_run_over_the_gaps_of_a_cutoff(panel):
    df, sdf = panel
    got = ipw_weights(sdf, "id", "start", "stop", [exposure()], "v", [6.0, 12.0]).toPandas()
    for cutoff in (6.0, 12.0):
        ordered, expected = dense_weights(df[df["v"] <= cutoff])
        part = got[got["cutoff"] == cutoff].sort_values(["id", "stop"])
        assert list(part["stop"]) == list(ordered["stop"])
        np.testing.assert_allclose(part["w_treat"], expected, rtol=1e-5)


def test_missing_covariates_in_weight_models_are_an_error(spark, panel):
    df, _ = panel
    holes = df.copy()
    holes.loc[0, "a"] = np.nan
    with pytest.raises(Exception, match="missing values in the covariates"):
        ipw_weights(spark.createDataFrame(holes), "id", "start", "stop", [exposure()])


def test_first_exposure_rows_and_products(spark):
    df = spark.createDataFrame(
        [(1, 1, 0, 0.5), (1, 2, 1, 0.5), (1, 4, 1, 0.25), (2, 1, 0, 0.1), (2, 2, 0, 2.0)],
        "id int, t int, e int, p double",
    )
    kept = first_exposure_rows(df, "e", "id", "t").select("id", "t").collect()
    assert sorted(map(tuple, kept)) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    got = df.select("id", "t", cumulative_product("p", "id", "t").alias("c")).collect()
    assert {(r[0], r[1]): r[2] for r in got} == pytest.approx(
        {(1, 1): 0.5, (1, 2): 0.25, (1, 4): 0.0625, (2, 1): 0.1, (2, 2): 0.2}
    )


# --------------------------------------------------------------------------
# sweeps

MODEL = EffectModel("id", "start", "stop", "event", (exposure(), exposure("cens", "dropout")),
                    terms("exposed", "a"))


def test_sweep_matches_dense_and_single_runs(panel):
    df, sdf = panel
    cutoffs = [8.0, 15.0, 100.0]
    sweep = cutoff_sweep(sdf, MODEL, "v", cutoffs).effects.toPandas()
    for cutoff in cutoffs:
        part, treat = dense_weights(df[df["v"] <= cutoff])
        _, cens = dense_weights(df[df["v"] <= cutoff], "dropout")
        w, x = treat * cens, part[["exposed", "a"]].to_numpy(dtype=float)
        beta = dense.fit(x, *times(part), w)
        se = dense.robust_se(beta, x, *times(part), w, part["id"].to_numpy())
        rows = sweep[sweep["cutoff"] == cutoff].set_index("term")
        np.testing.assert_allclose(rows.loc[["exposed", "a"], "coef"], beta, atol=1e-5)
        np.testing.assert_allclose(rows.loc[["exposed", "a"], "se"], se, rtol=1e-4)
    one = single_cutoff(sdf, MODEL, "v", 15.0).effects.toPandas().set_index("term")
    rows = sweep[sweep["cutoff"] == 15.0].set_index("term")
    for c in ("coef", "se", "lo95", "hi95"):
        np.testing.assert_allclose(rows[c], one[c], rtol=1e-6)


def test_sweep_equals_weights_then_outcome(panel):
    _, sdf = panel
    weights = ipw_weights(sdf, "id", "start", "stop", MODEL.exposures).select("id", "stop", F.col("w").alias("ipw"))
    joined = sdf.join(weights, ["id", "stop"])
    a = by_term(cox_fit(joined, "id", "start", "stop", "event", MODEL.outcome, weight="ipw"))
    b = by_term(cutoff_sweep(sdf, MODEL, None))
    for term in a:
        assert a[term]["coef"] == pytest.approx(b[term]["coef"], abs=1e-7)
        assert a[term]["se"] == pytest.approx(b[term]["se"], rel=1e-6)


def test_cutoff_helpers(spark):
    df = spark.createDataFrame([(1, 2.1), (2, 2.2), (3, None)], "id int, v double")
    got = {r[0]: r[1] for r in cutoff_counts(df, "v", [2.0, 2.1, 2.2]).collect()}
    assert got == {2.0: 0, 2.1: 1, 2.2: 2}
    rows = expand_cutoffs(df, "v", [2.0, 2.1, 2.2]).select("id", "cutoff").collect()
    assert sorted(map(tuple, rows)) == [(1, 2.1), (1, 2.2), (2, 2.2)]
    bound = bind_rows([(1, df), (2, df.drop("v"))], "part")
    assert bound.columns == ["part", "id", "v"] and bound.count() == 6


def test_design_and_scaling(spark):
    df = spark.createDataFrame(
        [("f", 1.0, "p"), ("m", 3.0, "p"), (None, 5.0, "q")], "g string, x double, k string"
    )
    design, _ = build_design(df, terms(Numeric("x", 2), Category("g")))
    assert design.labels == ("x/2", "g=m")
    got = [tuple(r) for r in df.select(*design.columns).collect()]
    assert got == [(-1.0, 0.0), (0.0, 1.0), (1.0, None)]
    scaled = centre_scale(df, {"x": 2}).select("x").collect()
    assert [r[0] for r in scaled] == [-1.0, 0.0, 1.0]
    grouped = centre_scale(df, {"x": 2}, by="k").collect()
    assert {(r["g"], r["x"]) for r in grouped} == {("f", -0.5), ("m", 0.5), (None, 0.0)}


# --------------------------------------------------------------------------
# sums over any number of times, stays of any length


def test_nodes_cover_each_time_at_risk_once():
    """Adding the nodes above a time gives the risk set there, whatever range the nodes were dealt to."""
    rng = np.random.default_rng(2)
    last = 3 * (1 << riskset.RANGE) + 77
    start = rng.integers(0, last, 300)
    stop = np.array([rng.integers(s + 1, last + 1) for s in start])
    start[0], stop[0] = 0, last
    frame = pd.DataFrame({"_id": np.arange(300), "_start": start, "_stop": stop, "_value": 0.0})
    at_risk = riskset.risk_rows(riskset._block(frame, 0))
    assert np.bincount(at_risk.row).max() <= 2 * 15
    which, ranges = riskset.ranges_of(at_risk.node, last)
    for number in range((last >> riskset.RANGE) + 1):
        store = riskset.Store()
        here = which[ranges == number]
        store.add(at_risk.node[here], np.eye(300)[at_risk.row[here]])
        store.merge()
        times_ = np.arange(max(1, number << riskset.RANGE), min(last + 1, (number + 1) << riskset.RANGE))
        got = riskset.at_times(times_, store.keys, store.sums)
        assert (got == ((start < times_[:, None]) & (times_[:, None] <= stop))).all()


def test_one_stay_of_any_length(spark):
    """A stay of 300,000 rows spans many batches; coefficients and robust errors equal the ordered sums."""
    n, rng = 300_000, np.random.default_rng(8)
    hot = pd.DataFrame({"id": 0, "start": np.arange(n), "stop": np.arange(1, n + 1)})
    k = 3_000  # other stays: one long row each, that crosses many times
    first = rng.integers(0, n - 1, k)
    others = pd.DataFrame({"id": np.arange(1, k + 1), "start": first, "stop": [rng.integers(a + 1, n + 1) for a in first]})
    df = pd.concat([hot, others], ignore_index=True)
    df["x"] = rng.normal(size=len(df))
    df["event"] = (rng.random(len(df)) < np.where(df["id"] == 0, 0.002, 0.5)).astype(int)
    df["w"] = rng.uniform(0.5, 2, len(df))
    got = by_term(cox_fit(spark.createDataFrame(df), "id", "start", "stop", "event", terms("x"), weight="w"))["x"]

    x, w = df["x"].to_numpy(), df["w"].to_numpy()
    start, stop, event = times(df)
    xc = x - x.mean()
    at = np.unique(stop[event == 1])

    def sums(values, beta):
        """Over the risk sets of the event times, by sorted starts and ends."""
        by = lambda edge: np.concatenate([[0.0], np.cumsum(values[np.argsort(edge, kind="stable")])])[
            np.searchsorted(np.sort(edge), at, side="left")
        ]
        return by(start) - by(stop)

    def tied(values):
        return np.bincount(np.searchsorted(at, stop[event == 1]), values[event == 1], len(at))

    d = tied(np.ones(len(df)))
    mean_w = tied(w) / d

    def efron(f, r):
        s0, s1, s2 = (sums(r * xc**q, 0) for q in range(3))
        t0, t1, t2 = (tied(r * xc**q) for q in range(3))
        out = 0.0
        for step in range(int(d.max())):
            on, part = d > step, step / d
            out = out + np.where(on, f(part, s0 - part * t0, s1 - part * t1, s2 - part * t2), 0.0)
        return out

    beta = 0.0
    for _ in range(20):
        r = w * np.exp(beta * xc)
        grad = (w * xc)[event == 1].sum() - (mean_w * efron(lambda f, a, b, c: b / a, r)).sum()
        info = (mean_w * efron(lambda f, a, b, c: c / a - (b / a) ** 2, r)).sum()
        beta += grad / info
    assert got["converged"] and got["coef"] == pytest.approx(beta, abs=1e-8)

    r = w * np.exp(beta * xc)
    mean = efron(lambda f, a, b, c: b / a, r) / d
    part = lambda f: np.concatenate([[0.0], np.cumsum(f)])
    hazard = mean_w * efron(lambda f, a, b, c: 1 / a, r)
    drift = mean_w * efron(lambda f, a, b, c: b / a**2, r)
    own_hazard = mean_w * efron(lambda f, a, b, c: (1 - f) / a, r)
    own_drift = mean_w * efron(lambda f, a, b, c: (1 - f) * b / a**2, r)
    low, high = np.searchsorted(at, start, side="right"), np.searchsorted(at, stop, side="right") - event
    h, g = part(hazard)[high] - part(hazard)[low], part(drift)[high] - part(drift)[low]
    own = np.minimum(high, len(at) - 1)
    h, g = h + event * own_hazard[own], g + event * own_drift[own]
    score = w * (event * (xc - mean[own]) - np.exp(beta * xc) * (xc * h - g))
    meat = (np.bincount(df["id"], score) ** 2).sum()
    assert got["se"] == pytest.approx(math.sqrt(meat) / info, rel=1e-7)


def test_weights_of_a_stay_that_spans_batches(spark, panel):
    """Running weights are handed on from batch to batch."""
    _, sdf = panel
    both = [exposure(), exposure("cens", "dropout")]
    a = ipw_weights(sdf, "id", "start", "stop", both).toPandas().sort_values(["id", "stop"])
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        b = ipw_weights(sdf, "id", "start", "stop", both).toPandas().sort_values(["id", "stop"])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    np.testing.assert_allclose(a["w"], b["w"], rtol=1e-9)
