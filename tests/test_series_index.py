from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pricetrail.operators import chain, series
from tests.helpers import obs, rows


def quarter_prices(spark, data: list[tuple[str, str, int]]):
    return spark.createDataFrame(data, "mpn string, p string, price_minor long").select("mpn", F.to_date("p").alias("period"), "price_minor")


Q = ["2024-01-01", "2024-04-01", "2024-07-01", "2024-10-01"]


def index_rows(spark, data, base=Q[0], floor=1):
    df = chain.matched_model_index(quarter_prices(spark, data), base, floor)
    return {r["period_id"]: r for r in df.collect()}


def test_jevons_is_geometric(spark):
    pairs = quarter_prices(spark, [("a", Q[0], 100), ("a", Q[1], 50), ("b", Q[0], 100), ("b", Q[1], 200)])
    assert chain.matched_links(chain.matched_pairs(pairs)).first()["link"] == pytest.approx(1.0)


def test_matched_only(spark):
    r = index_rows(spark, [("A", Q[0], 10000), ("A", Q[1], 11000), ("B", Q[1], 90000)])["2024Q2"]
    assert (r["link"], r["index_value"], r["matched_product_count"], r["distinct_products_in_period"]) == (1.1, 110.0, 1, 2)


def test_churn_does_not_move_the_index(spark):
    r = index_rows(spark, [("A", Q[0], 10000), ("L", Q[0], 500), ("A", Q[1], 10000), ("N", Q[1], 90000)])["2024Q2"]
    assert (r["link"], r["index_value"]) == (1.0, 100.0)


def test_thin_link_stops_the_chain(spark):
    data = [(m, q, 100) for m in "AB" for q in Q[:2]] + [("A", Q[2], 100), ("A", Q[3], 100)]
    got = index_rows(spark, data, floor=2)
    assert got["2024Q2"]["state"] == "observed"
    assert (got["2024Q3"]["state"], got["2024Q3"]["index_value"], got["2024Q3"]["matched_product_count"]) == ("insufficient_matched_evidence", None, 1)
    assert got["2024Q4"]["state"] == "outside_stopped_chain"


def test_spine_states(spark):
    got = index_rows(spark, [("A", Q[0], 100), ("A", Q[2], 100), ("A", Q[3], 100)])
    assert [got[p]["state"] for p in ("2024Q1", "2024Q2", "2024Q3", "2024Q4")] == [
        "observed", "no_observations", "outside_stopped_chain", "outside_stopped_chain"
    ]


def test_two_way_chain(spark):
    got = index_rows(spark, [("A", Q[0], 20000), ("A", Q[1], 10000), ("A", Q[2], 5000)], base=Q[1])
    assert [got[p]["index_value"] for p in ("2024Q1", "2024Q2", "2024Q3")] == [200.0, 100.0, 50.0]
    assert got["2024Q1"]["link"] is None and got["2024Q1"]["matched_product_count"] == 1
    assert got["2024Q2"]["reference_period"]


def test_dispersion_takes_upper_median(spark):
    data = [(m, Q[0], 100) for m in "ABCD"] + [("A", Q[1], 100), ("B", Q[1], 100), ("C", Q[1], 400), ("D", Q[1], 200)]
    r = index_rows(spark, data)["2024Q2"]
    assert (r["relative_min"], r["relative_median"], r["relative_max"]) == (1.0, 2.0, 4.0)


def test_coverage_and_extremes(spark):
    df = chain.matched_model_index(quarter_prices(spark, [("A", Q[0], 100), ("A", Q[1], 300), ("A", Q[3], 100)]), Q[0], 1)
    assert rows(chain.index_coverage(df)) == [("2024Q1", "2024Q2", 2, 1, 3)]
    assert rows(chain.index_extremes(df)) == [("2024Q2", 300.0, "2024Q1", 100.0, "2024Q2", 300.0)]


def test_period_collapse(spark):
    points = spark.createDataFrame(
        [("A", "2024-01-01", 10000), ("A", "2024-02-01", 12000), ("A", "2024-03-01", 50000)], "mpn string, m string, median_minor long"
    ).select("mpn", F.to_date("m").alias("month"), "median_minor")
    assert series.collapse_to_periods(points).first()["price_minor"] == 12000


def test_one_seller_one_vote(spark):
    o = obs(spark, [
        ("A", "busy", "2024-01-02", 100, True), ("A", "busy", "2024-01-03", 100, True), ("A", "busy", "2024-01-04", 100, True),
        ("A", "calm", "2024-01-05", 300, True), ("A", "other", "2024-01-06", 900, None),
    ])
    r = series.per_product_month_series(o).first()
    assert (r["median_minor"], r["seller_count"], r["low_minor"], r["high_minor"], r["excluded_seller_count"]) == (200, 2, 100, 300, 1)
    votes = {v["seller"]: v for v in series.month_contributors(o).collect()}
    assert votes["busy"]["capture_count"] == 3
    assert votes["other"]["exclusion_reason"] == "VAT_BASIS_NOT_COMPARABLE" and votes["other"]["vat_included"] is None


def test_comparable_rows_decide_a_mixed_seller(spark):
    o = obs(spark, [("A", "s", "2024-01-02", 100, True), ("A", "s", "2024-01-03", 900, False), ("A", "s", "2024-01-04", 900, None)])
    v = series.month_contributors(o).first()
    assert (v["amount_minor"], v["capture_count"], v["vat_included"], v["exclusion_reason"]) == (100, 3, True, None)


def test_month_without_comparable_price_stays_visible(spark):
    r = series.per_product_month_series(obs(spark, [("A", "s", "2024-01-02", 100, False)])).first()
    assert (r["state"], r["median_minor"], r["seller_count"], r["single_seller"]) == ("no_comparable_price", None, 0, False)


def test_envelope_keeps_empty_quarters_and_ties(spark):
    o = obs(spark, [("B", "s", "2024-01-02", 100, True), ("A", "t", "2024-01-03", 100, None), ("A", "s", "2024-08-01", 70, False)])
    got = {r["period_id"]: r for r in series.price_envelope(o).collect()}
    assert sorted(got) == ["2024-Q1", "2024-Q2", "2024-Q3"]
    q1 = got["2024-Q1"]
    assert (q1["low_observation_id"], q1["high_observation_id"], q1["observation_count"]) == ("o-000", "o-000", 2)
    assert (q1["vat_resolved_count"], q1["vat_unresolved_count"]) == (1, 1)
    assert got["2024-Q2"]["state"] == "no_eligible_evidence" and got["2024-Q2"]["low_minor"] is None


def test_gaps_and_segments(spark):
    o = obs(spark, [("A", "s", f"2024-{m:02d}-02", 100, True) for m in (1, 2, 5, 6)])
    points = series.monthly_medians(o)
    assert rows(series.coverage_gaps(points)) == [("A", "2024-02", "2024-05", "unobserved", 2)]
    segments = series.contiguous_segments(points, ["mpn"], "month", "month")
    assert rows(segments, "segment_no", "point_count") == [(1, 2), (2, 2)]


@pytest.mark.parametrize("parts", [1, 13])
def test_results_do_not_depend_on_partitioning(spark, parts):
    data = [(f"P{i % 7}", f"s{i % 3}", f"2024-{i % 12 + 1:02d}-{i % 27 + 1:02d}", 100 + i * 37 % 91, [True, False, None][i % 3]) for i in range(200)]
    o = obs(spark, data)
    base = rows(series.per_product_month_series(o))
    assert rows(series.per_product_month_series(o.repartition(parts).orderBy(F.desc("observation_id")))) == base
    assert rows(series.price_envelope(o.repartition(parts))) == rows(series.price_envelope(o))


def test_later_rows_leave_earlier_points_alone(spark):
    data = [("A", "s", "2024-01-02", 100, True), ("A", "t", "2024-02-02", 300, True)]
    before = rows(series.per_product_month_series(obs(spark, data)))
    after = rows(series.per_product_month_series(obs(spark, [*data, ("A", "s", "2024-03-02", 900, True)])))
    assert after[:2] == before
