import pytest
from pyspark.sql import functions as F

from tamarisk.functions import credit
from tamarisk.operators import ecl, models

LOANS = """SELECT * FROM VALUES
  ('L1', 'AAA', 'تمويل عقاري', 0, '2022-01-01', '2031-01-01', 100000.0D, 1, 25.0D, 'c1'),
  ('L2', 'BB', 'تمويل شخصي', 45, '2023-01-01', '2028-08-07', 50000.0D, 2, 900.0D, 'c2'),
  ('L3', 'D', 'بطاقة ائتمانية', 120, '2023-01-01', 'not a date', 10000.0D, 3, 6500.0D, 'c9'),
  ('L4', 'ZZZ', 'تمويل تجاري', 5, '2024-01-01', '2026-08-08', 20000.0D, 1, 900.0D, NULL)
  AS t(LOAN_ID, RATING, FACILITY_TYPE, DPD, ORIGINATION, MATURITY, EAD, STAGE, ECL_SAR, CUST_ID)"""


@pytest.fixture(scope="module")
def loans(spark):
    return spark.sql(LOANS)


def by_id(df):
    return {r["LOAN_ID"]: r for r in df.collect()}


def test_simple_portfolio_to_the_cent(spark):
    rows = "SELECT * FROM VALUES ('A', 1, 0.01D, 0.4D, 100000.0D, 400.0D), ('B', 2, 0.1D, 0.5D, 40000.0D, 2000.0D), ('C', 3, 1.0D, 0.62D, 10000.0D, {}D) AS t(LOAN_ID, STAGE, PD, LGD, EAD, ECL_SAR)"
    good = ecl.simple(spark.sql(rows.format("6200.0"))).first()
    assert (good["loan_count"], good["total_ead"], good["total_ecl"], good["matches_source"]) == (3, 150000.0, 8600.0, True)
    assert good["coverage_ratio"] == 0.0573
    assert ecl.simple(spark.sql(rows.format("999999.0"))).first()["matches_source"] is False
    assert {r["stage"]: r["loans"] for r in ecl.simple_stages(spark.sql(rows.format("1.0"))).collect()} == {1: 1, 2: 1, 3: 1}


def test_missing_columns_are_named(spark):
    df = spark.sql("SELECT 1 AS LOAN_ID, 0.1D AS PD")
    with pytest.raises(ValueError, match="LGD.*EAD"):
        ecl.simple(df)
    with pytest.raises(ValueError, match="RATING"):
        ecl.per_loan(df)


def test_stages_terms_and_unknowns(loans):
    rows = by_id(ecl.per_loan(loans))
    assert [rows[k]["computed_stage"] for k in ("L1", "L2", "L3", "L4")] == [1, 2, 3, 1]
    assert rows["L4"]["term_years"] == 0.1
    assert rows["L3"]["term_years"] is None and rows["L3"]["ecl_base"] is None
    assert rows["L2"]["effective_pd"] == pytest.approx(1 - (1 - 0.04) ** (731 / 365.25))
    assert rows["L4"]["unknown_rating"] and rows["L4"]["start_pd"] == 0.1
    assert [(r["kind"], r["value"]) for r in ecl.unknown_values(ecl.per_loan(loans)).collect()] == [("rating", "ZZZ")]


def test_scenarios_are_ordered_and_weights_sum_to_one(loans):
    rows = {r["scenario"]: r for r in ecl.by_scenario(ecl.per_loan(loans)).collect()}
    assert rows["optimistic"]["ecl"] < rows["base"]["ecl"] < rows["adverse"]["ecl"]
    assert sum(r["weight"] for r in rows.values()) == pytest.approx(1.0)
    blend = sum(r["weight"] * r["ecl"] for r in rows.values())
    assert ecl.expected(ecl.per_loan(loans)).first()[0] == pytest.approx(blend, abs=0.02)


def test_agreement_with_source(loans):
    assert ecl.source_agreement(ecl.per_loan(loans)).first()["stage_agreement"] == 1.0


def test_fallback_and_unknown_scenario(loans):
    assert "stated_ecl" in ecl.assess(loans.withColumns({"PD": F.lit(0.1), "LGD": F.lit(0.4)}).drop("RATING")).columns
    with pytest.raises(ValueError, match="unknown scenario"):
        ecl.totals(ecl.per_loan(loans), "worst")


@pytest.mark.parametrize("column,value,stage", [
    ("watchlist", "true", 2), ("Watchlist", "False", 1), ("restructure_request", "yes", 2), ("restructured", "1", 3),
    ("legal_proceedings", "true", 3), ("formal_default", None, 1), ("restructuring_requested", "true", 2)])
def test_trigger_columns(loans, column, value, stage):
    flagged = loans.where("LOAN_ID = 'L1'").withColumn(column, F.lit(value).cast("string"))
    assert ecl.per_loan(flagged).first()["computed_stage"] == stage


def test_substring_matching_lets_a_request_count_as_restructured(loans):
    flagged = loans.where("LOAN_ID = 'L1'").withColumn("restructuring_requested", F.lit(True))
    assert ecl.per_loan(flagged, substring_match=True).first()["computed_stage"] == 3


def test_trigger_disclosure(loans):
    t = ecl.triggers(loans.withColumn("watchlist", F.lit(True))).collect()
    assert [(r["trigger"], r["loans"]) for r in t if r["evaluated"]] == [("days past due backstop (30/90 days)", 2), ("watchlist flag", 4)]
    assert len(t) == 7


def test_names_come_from_the_customer_file(spark, loans):
    customers = spark.sql("SELECT * FROM VALUES ('c1', 'Old', 0), ('c1', 'New', 1), ('c2', NULL, 2), (NULL, 'Nobody', 3) AS t(cust_id, full_name, row_pos)")
    top = ecl.top_loans(ecl.per_loan(loans), customers, k=3).collect()
    names = {r["id"]: r["name"] for r in top}
    assert [r["ecl"] for r in top] == sorted((r["ecl"] for r in top), reverse=True)
    assert names.get("L1", "New") == "New" and names["L2"] == "unnamed record"
    placed = loans.withColumn("_row_pos", F.lit(7))
    assert {r["id"]: r["name"] for r in ecl.top_loans(ecl.per_loan(placed), customers, k=3).collect()}["L2"] == "Record 7"


def test_fitted_scorecard_rises_with_rank(spark):
    labels = spark.sql("""SELECT r AS RATING, rand(7) < p AS defaulted FROM VALUES ('AAA', 0.001D), ('A', 0.006D), ('BB', 0.04D), ('CCC', 0.25D), ('D', 1.0D) AS t(r, p)
                          LATERAL VIEW explode(sequence(1, 400)) s""")
    pds = [r["rating_pd"] for r in models.fit_default_scorecard(labels).orderBy("rating_rank").collect()]
    assert len(pds) == 10 and pds == sorted(pds) and 0 < pds[0] < 0.05 and pds[-1] > 0.5


def test_fitted_severity_is_the_clipped_mean(spark):
    df = spark.sql("SELECT * FROM VALUES ('تمويل عقاري', 0.2D), ('تمويل عقاري', 0.3D), ('تمويل شخصي', 1.5D), ('other', 0.9D) AS t(FACILITY_TYPE, severity)")
    assert {r[0]: r[1] for r in models.fit_severity(df).collect()} == {"تمويل عقاري": 0.25, "تمويل شخصي": 0.95}


def test_repeated_parameters_are_refused(spark, loans):
    twice = spark.sql("SELECT * FROM VALUES ('AAA', 0, 0.1D), ('AAA', 0, 0.2D) AS t(rating_key, rating_rank, rating_pd)")
    with pytest.raises(ValueError, match="rating_key is repeated"):
        ecl.per_loan(loans, ratings=twice)


def test_large_exposures_are_summed_exactly(spark):
    df = spark.sql("SELECT * FROM VALUES (0.0000005D), (2e12D), (3e20D), (CAST(NULL AS DOUBLE)) AS t(x)")
    assert int(df.agg(credit.total(F.col("x")).alias("t")).first()[0]) == 300000000000000000000 * 10**6 + 2 * 10**18 + 1
    assert df.where("x IS NULL").agg(credit.total(F.col("x")).alias("t")).first()[0] is None


def test_an_infinite_amount_is_an_error(spark):
    one = lambda *values: spark.createDataFrame([(v,) for v in values], "x double").agg(credit.amount(credit.total(F.col("x"))).alias("t"))
    assert one(1.5, float("nan"), None, 2e12).first().t == 2e12 + 1.5
    with pytest.raises(Exception, match="an amount is infinite"):
        one(1.5, float("inf")).collect()
