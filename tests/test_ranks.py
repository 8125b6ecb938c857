"""Quantiles by narrowed bands, co-moments of many columns, ranks per pattern of gaps: against numpy and pandas."""

import random

import numpy as np
import pandas as pd
import pytest

from tabwise.operators import comoments, quantiles as Q, stats as S


def frame(spark, data: pd.DataFrame):
    rows = [tuple(None if v is None or v != v else float(v) for v in r) for r in data.itertuples(index=False)]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in data.columns)).repartition(5)


@pytest.mark.parametrize("accuracy, band", [(20, 5), (100, 40), (20_000, 1)])
def test_narrowed_bands(spark, accuracy, band):
    rng = np.random.default_rng(accuracy)
    n = 3_000
    data = pd.DataFrame({
        "plain": rng.standard_normal(n), "heavy": np.where(rng.random(n) < 0.4, 7.0, rng.integers(0, 30, n)), "wide": 10.0 ** rng.uniform(-300, 300, n),
        "near": 1e9 + rng.integers(0, 5, n) * 1e-6, "one": np.full(n, 3.5), "two": np.r_[np.full(n - 1, -1.0), 5.0], "gaps": np.where(rng.random(n) < 0.5, np.nan, rng.random(n)),
    })
    data["none"] = np.nan
    probs = [0.0, 0.001, 0.25, 1 / 3, 0.5, 0.75, 0.999, 1.0]
    got = Q._banded_quantiles(frame(spark, data), list(data.columns), probs, accuracy, band)
    for c in data.columns:
        own = np.sort(data[c].dropna().to_numpy())
        for p, v in zip(probs, got[c]):
            if not len(own):
                assert v is None
                continue
            at = p * (len(own) - 1)
            lo, hi = own[int(np.floor(at))], own[int(np.ceil(at))]
            assert v == lo + (hi - lo) * (at - np.floor(at)), (c, p)


def test_both_sides_of_the_row_limit(spark):
    data = pd.DataFrame({"a": np.random.default_rng(1).integers(0, 50, 500).astype(float)})
    df = frame(spark, data)
    assert Q.exact_quantiles(df, ["a"], [0.1, 0.5, 0.9], 500) == Q.exact_quantiles(df, ["a"], [0.1, 0.5, 0.9], 499)


def gappy(n=400, columns=14, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, columns)) @ rng.standard_normal((columns, columns)) + 1e6
    data = pd.DataFrame(base, columns=[f"c {i}.x" for i in range(columns)])
    holes = rng.random((n, 4)) < 0.3
    for i, c in enumerate(data.columns):
        if i % 3:
            data.loc[holes[:, i % 4], c] = np.nan
    data["fixed"] = 2.5
    data["ties"] = rng.integers(0, 3, n).astype(float)
    data["lonely"] = np.where(np.arange(n) == 5, 1.0, np.nan)
    data["nothing"] = np.nan
    return data


def table(rows):
    return {(r["col1"], r["col2"]): r["r"] for r in rows}


def close(got, want):
    for (a, b), r in got.items():
        w = want.loc[a, b]
        assert (r is None) == bool(np.isnan(w)), (a, b, r, w)
        assert r is None or abs(r - w) < 1e-9, (a, b, r, w)


def test_pearson_of_many_columns(spark):
    data = gappy()
    df, names = frame(spark, data), list(data.columns)
    many, few = table(S.pearson_pairs(df, names).collect()), table(S.pearson_pairs(df, names, few=99).collect())
    assert set(many) == set(few) and len(many) == len(names) * (len(names) - 1) // 2
    want = data.corr(min_periods=2)
    close(many, want)
    close(few, want)
    assert S.pearson_pairs(df.limit(0), names).where("r is not null").count() == 0


def test_spearman_over_patterns_of_gaps(spark, monkeypatch):
    data = gappy(150, 7)
    df, names = frame(spark, data), list(data.columns)
    pattern = S.gap_patterns(df, names)
    assert pattern[0] == pattern[3] == pattern[names.index("ties")] and pattern[1] == pattern[5] != pattern[2]
    want = pd.DataFrame(np.nan, names, names)
    for a in names:
        for b in names:
            both = data[[a, b]].dropna()
            if a != b and both[a].nunique() > 1 and both[b].nunique() > 1:
                want.loc[a, b] = np.corrcoef(both[a].rank(), both[b].rank())[0, 1]
    close(table(S.spearman_pairs(df, names).collect()), want)
    monkeypatch.setattr(S, "HOT", 20)
    close(table(S.spearman_pairs(df, names[-8:]).collect()), want)


def test_ranks_by_key_in_ranges(spark):
    r = random.Random(4)
    rows = [(r.randrange(4), float(r.randrange(40))) for _ in range(900)]
    entries = spark.createDataFrame(rows, "key int, value double")
    own = pd.DataFrame(rows, columns=["key", "value"])
    own["rank"] = own.groupby("key")["value"].rank()
    want = {(k, v): x for k, v, x in own.itertuples(index=False)}
    for size in (7, 10**6):
        got = Q.keyed_ranks(entries, size).collect()
        assert {(g["key"], g["value"]): g["rank"] for g in got} == want and sum(g["n"] for g in got) == 900


def test_scans_do_not_grow_with_pairs(spark):
    df = spark.range(50).selectExpr(*[f"cast(id * {i} % 7 as double) as c{i}" for i in range(40)])
    plan = comoments.correlations(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 2 and plan.count("Range (") <= 2
