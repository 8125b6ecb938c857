"""Known results of five small files, end to end."""

import pytest

import samples
from tabwise.operators import clean as K, models as M, stats as S
from tabwise.plans.analyse import analyse
from tabwise.sources.files import read_delimited

FILES = {
    "retail": samples.RETAIL, "patients": samples.PATIENTS, "loans": samples.LOANS, "messy": samples.MESSY,
    "ambiguous": samples.AMBIGUOUS,
}


@pytest.fixture(scope="module")
def runs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("goldens")
    out = {}
    for name, text in FILES.items():
        path = folder / f"{name}.csv"
        path.write_text(text, encoding="utf-8")
        df = read_delimited(spark, str(path))
        out[name] = (df, analyse(df, name))
    return out


def log_of(run, column):
    return [r for r in run.cleaned.log_rows if r["column"] == column]


def test_row_ids_follow_the_file(runs):
    df = runs["messy"][0]
    assert [(r["_row_id"], r["record_id"]) for r in df.orderBy("_row_id").collect()][3:6] == [(3, "REC-04"), (4, "REC-05"), (5, "REC-05")]


def test_quality_and_domain(runs):
    got = {n: (a.facts.quality.first()["score"], *a.facts.domain.first()) for n, (_, a) in runs.items()}
    assert got == {
        "retail": (98, "retail", 0.95), "patients": (94, "healthcare", 0.95), "loans": (98, "finance", 0.95),
        "messy": (86, "generic", 0.5), "ambiguous": (81, "generic", 0.5),
    }


def test_types_and_labels(runs):
    def columns(name):
        return {r["name"]: (r["dtype_inferred"], r["semantic_label"], r["pii_type"]) for r in runs[name][1].facts.profile.collect()}

    r = columns("retail")
    assert r["order_id"][:2] == ("int", "identifier") and r["order_date"][:2] == ("date", "unknown")
    assert r["discount_pct"][:2] == ("float", "quantity") and r["status"][:2] == ("category", "target_label")
    p = columns("patients")
    assert p["glucose"][:2] == ("int", "health_metric") and p["treatment"][0] == "category" and p["discharge_date"][0] == "date"
    m = columns("messy")
    assert m[" user_category "][0] == "category" and m["metric_score"][:2] == ("float", "score") and m["flag_active"][0] == "bool"
    a = columns("ambiguous")
    assert [a[c][2] for c in ("full_name", "email", "phone_number", "credit_card", "amount")] == ["name", "email", "phone", "credit_card", "none"]


def test_dates(runs):
    def dates(name):
        return {r["column"]: (r["detected_format"], r["confidence"], r["needs_confirmation"]) for r in runs[name][1].facts.dates.collect()}

    assert dates("retail") == {"order_date": ("DD/MM/YYYY", 1.0, False)}
    assert dates("patients")["admission_date"] == ("YYYY-MM-DD", 1.0, False)
    assert dates("ambiguous") == {"subscription_date": ("ambiguous", 0.5, True)}
    assert sorted(r[0] for r in runs["retail"][1].table.select("order_date").collect())[0] == "2024-01-25"
    assert runs["ambiguous"][1].table.where("subscription_date = '05/06/2024'").count() == 1


def test_duplicates(runs):
    run = runs["messy"][1]
    dup = log_of(run, "ALL_COLUMNS")[0]
    assert dup["details"] == {"duplicate_count": 1.0, "duplicate_pct": 14.29}
    assert [r["_orig_row_index"] for r in run.cleaned.removed.collect()] == [5]


def test_imputation(runs):
    m, p = runs["messy"][1], runs["patients"][1]
    assert [(r["method"], round(float(r["replacement_value"]), 2)) for r in log_of(m, "metric_score") if r["step_no"] == 4] == [("mean", 72.14)]
    assert [(r["method"], float(r["replacement_value"])) for r in log_of(p, "glucose") if r["step_no"] == 4] == [("mean", 123.0)]
    assert [(r["method"], r["replacement_value"]) for r in log_of(m, " user_category ") if r["step_no"] == 4] == [("mode", "Enterprise")]
    assert [(r["method"], r["replacement_value"]) for r in log_of(m, "notes") if r["step_no"] == 4] == [("mode", "Active account")]
    assert [(r["method"], r["missing_pct"]) for r in log_of(p, "treatment") if r["step_no"] == 4] == [("constant_unknown", 33.33)]
    cells = {(r["column"], r["_row_id"]) for r in m.cleaned.null_cells.collect()}
    assert cells == {("metric_score", 1), (" user_category ", 6), ("notes", 3)}
    assert p.table.where("discharge_date is null").select("_row_id").first()[0] == 4


@pytest.mark.parametrize("name,column,q1,q3,low,high,row", [
    ("retail", "price", 15.5, 49.99, -36.235, 101.725, 2),
    ("retail", "revenue", None, None, -35.8738, 149.4963, 2),
    ("loans", "account_balance", None, None, -4475.125, 11925.275, 2),
])
def test_outliers(runs, name, column, q1, q3, low, high, row):
    run = runs[name][1]
    d = [r for r in log_of(run, column) if r["method"] == "flag_outliers_iqr"][0]["details"]
    assert (d["lower_bound"], d["upper_bound"], d["outlier_count"]) == pytest.approx((low, high, 1.0), abs=1e-4)
    if q1 is not None:
        assert (d["q1"], d["q3"]) == (q1, q3)
    assert [r["_row_id"] for r in run.cleaned.outliers.where(f"column = '{column}'").collect()] == [row]


def test_numeric_summary(runs):
    rows = {r["column"]: r for r in runs["retail"][1].facts.numeric.collect()}
    p, v = rows["price"], rows["revenue"]
    assert (p["mean"], p["std"], p["q25"], p["median"], p["q75"], p["skewness"], p["kurtosis"]) == (43.2883, 41.7415, 15.5, 32.745, 49.99, 1.5176, 2.3389)
    assert (v["mean"], v["std"], v["median"], v["skewness"], v["kurtosis"]) == (106.005, 150.0437, 45.775, 2.303, 5.4114)


def test_categories_hide_identifiers(runs):
    rows = {r["column"]: r for r in runs["retail"][1].facts.categorical.collect()}
    assert [(t["value"], t["n"]) for t in rows["status"]["top_categories"]] == [("delivered", 4), ("returned", 1), ("shipped", 1)]
    assert rows["sku"]["top_category"] is None and rows["sku"]["unique_count"] == 4


def test_top_pairs(runs):
    top = [(r["col1"], r["col2"], r["pearson_r"]) for r in runs["retail"][1].top_pairs.limit(3).collect()]
    assert top == [("price", "revenue", 0.9423), ("discount_pct", "revenue", 0.853), ("price", "discount_pct", 0.7917)]


def test_targets_and_model_status(runs):
    got = {n: (a.model.get("target"), a.model["status"]) for n, (_, a) in runs.items()}
    assert got == {
        "retail": ("status", "insufficient_data"), "patients": ("age", "insufficient_data"), "loans": ("default_status", "insufficient_data"),
        "messy": (" user_category ", "insufficient_data"), "ambiguous": ("amount", "insufficient_data"),
    }


@pytest.mark.parametrize("name", list(FILES))
def test_round_trip(runs, name):
    df, run = runs[name]
    c = run.cleaned
    back = K.reconstruct(c.table, c.removed, c.raw_cells, df.schema)
    assert back.columns == df.columns
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_insights_are_numbered_and_grounded(runs):
    from tabwise.operators.claims import ground_claims
    from pyspark.sql import functions as F

    run = runs["retail"][1]
    rows = run.insights.orderBy("id").collect()
    assert [r["id"] for r in rows] == [f"ins_{i + 1:03d}" for i in range(len(rows))] and len(rows) >= 4
    judged = ground_claims(run.insights.withColumn("dataset_id", F.lit("retail")), run.fact_base())
    bad = [(r["text"], r["ungrounded"]) for r in judged.where("not is_grounded and text not like '%order_date%'").collect()]
    assert bad == []
    assert run.insights.where("category = 'correlation'").count() == 2


def test_payload_and_context(runs):
    run = runs["ambiguous"][1]
    p = run.payload().first()
    assert set(p["pii_columns"]) == {"full_name", "email", "phone_number", "credit_card"}
    assert any("Temporal Ambiguity" in x for x in p["limitations"])
    text = run.context().first()[0]
    assert "### Dataset Overview" in text and "Johnathan" not in text and "4532" not in text


def test_charts(runs):
    plan = [(r["chart_type"], r["x_col"], r["y_col"]) for r in runs["retail"][1].chart_plan.orderBy("place").collect()]
    assert plan[:3] == [("correlation_heatmap", None, None), ("line_trend", "order_date", "price"), ("scatter", "price", "revenue")]
    assert len(plan) == 6 and all(t == "histogram" for t, *_ in plan[3:])


def test_leakage_rows(runs):
    df, run = runs["loans"]
    audit = {r["column"]: r for r in M.leakage_audit(run.table, run.facts.profile, "default_status").collect()}
    assert audit["transaction_id"]["reason"] == "identifier_exclusion" and audit["default_status"]["reason"] == "target_column"
    assert audit["credit_score"]["detection_method"] == "pearson_correlation"
    assert S.eligible_numeric(run.table, run.facts.profile.collect())[0] == "account_balance"
