"""Credit-loss queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarisk import params as P
from tamarisk.catalog.base import Registry, view
from tamarisk.operators import ecl
from tamarisk.operators import profile as prof

R = Registry()


def _values(mapping) -> str:
    return ", ".join(f"('{k}', {i}, {v!r}::DOUBLE)" for i, (k, v) in enumerate(mapping.items()))


_SCENARIO_SQL = ", ".join(
    f"least(pd * {p!r}::DOUBLE, 1::DOUBLE) * least(lgd * {g!r}::DOUBLE, 1::DOUBLE) * EAD + 0 * pd AS ecl_{s}"
    for s, (p, g, _) in P.SCENARIOS.items())

# Per-loan losses as SQL: the check's own statement of the formula.
MODEL_SQL = f"""
    WITH rp(rk, rank, rpd) AS (VALUES {_values(P.PD_BY_RATING)}), fp(fk, frank, flgd) AS (VALUES {_values(P.LGD_BY_FACILITY)}),
    a AS (SELECT l.* EXCLUDE (PD, LGD), rp.rk IS NULL AS unknown_rating, fp.fk IS NULL AS unknown_facility, rp.rank AS rank,
            coalesce(rpd, 0.1::DOUBLE) AS pd0, coalesce(flgd, 0.55::DOUBLE) AS lgd,
            CASE WHEN DPD > 90 THEN 3 WHEN DPD >= 30 OR WATCHLIST THEN 2 ELSE 1 END AS computed_stage,
            CASE WHEN MATURITY IS NULL THEN NULL
                 ELSE greatest((MATURITY - DATE '{P.REPORTING_DATE}') / 365.25::DOUBLE, 0.1::DOUBLE) END AS term
          FROM v_loans l LEFT JOIN rp ON RATING = rk LEFT JOIN fp ON FACILITY_TYPE = fk),
    b AS (SELECT *, CASE WHEN computed_stage > 1 THEN 1 - pow(1 - pd0, term) ELSE pd0 END AS pd FROM a),
    loss AS (SELECT *, {_SCENARIO_SQL} FROM b)"""
TOTAL = lambda x: f"CAST(sum(CAST(floor(({x}) * 1e6::DOUBLE + 0.5::DOUBLE) AS DECIMAL(18,0))) AS DECIMAL(28,0))"
AMOUNT = lambda x, k=2: f"CAST(round(({x}) * 0.000001, {k}) AS DOUBLE)"


def _loss(spark, sf):
    return ecl.per_loan(view(spark, sf, "v_loans"))


@R.query("ecl_by_stage", MODEL_SQL + f"""
    SELECT computed_stage AS stage, count(*) AS loans, {AMOUNT(TOTAL('EAD'))} AS ead, {AMOUNT(TOTAL('ecl_base'))} AS ecl FROM loss GROUP BY 1""")
def ecl_by_stage(spark, sf):
    return ecl.by_stage(_loss(spark, sf))


@R.query("ecl_total", MODEL_SQL + f"""
    SELECT count(*) AS loan_count, {AMOUNT(TOTAL('EAD'))} AS total_ead, {AMOUNT(TOTAL('ecl_base'))} AS total_ecl,
           round({TOTAL('ecl_base')}::DOUBLE / {TOTAL('EAD')}::DOUBLE, 4) AS coverage_ratio FROM loss""")
def ecl_total(spark, sf):
    return ecl.assess(view(spark, sf, "v_loans"))


@R.query("ecl_scenarios", MODEL_SQL + " " + " UNION ALL ".join(
    f"SELECT '{s}' AS scenario, {w!r}::DOUBLE AS weight, {AMOUNT(TOTAL('ecl_' + s))} AS ecl FROM loss" for s, (_, _, w) in P.SCENARIOS.items()))
def ecl_scenarios(spark, sf):
    return ecl.by_scenario(_loss(spark, sf))


@R.query("ecl_expected", MODEL_SQL + f"""
    SELECT {AMOUNT(TOTAL('ecl_optimistic') + ' * 0.25 + ' + TOTAL('ecl_base') + ' * 0.55 + ' + TOTAL('ecl_adverse') + ' * 0.20')} AS expected_ecl FROM loss""")
def ecl_expected(spark, sf):
    return ecl.expected(_loss(spark, sf))


@R.query("ecl_weighted_pd_lgd", MODEL_SQL + f"""
    SELECT round({TOTAL('pd * EAD')}::DOUBLE / {TOTAL('EAD')}::DOUBLE, 6) AS avg_pd,
           round({TOTAL('lgd * EAD')}::DOUBLE / {TOTAL('EAD')}::DOUBLE, 4) AS avg_lgd FROM loss""")
def ecl_weighted_pd_lgd(spark, sf):
    return ecl.weighted_pd_lgd(_loss(spark, sf))


@R.query("ecl_stage_counts", MODEL_SQL + """
    SELECT count(*) FILTER (WHERE computed_stage = 1) AS stage_1_count, count(*) FILTER (WHERE computed_stage = 2) AS stage_2_count,
           count(*) FILTER (WHERE computed_stage = 3) AS stage_3_count FROM loss""")
def ecl_stage_counts(spark, sf):
    return ecl.stage_counts(_loss(spark, sf))


@R.query("ecl_top5", MODEL_SQL + """
    , t AS (SELECT LOAN_ID, CUST_ID, ecl_base FROM loss ORDER BY ecl_base DESC NULLS LAST, LOAN_ID, CUST_ID LIMIT 5),
    c AS (SELECT CUST_ID, arg_max(FULL_NAME, row_pos) AS nm FROM v_customers GROUP BY 1)
    SELECT t.LOAN_ID AS id, round(t.ecl_base, 2) AS ecl, coalesce(c.nm, 'unnamed record') AS name FROM t LEFT JOIN c USING (CUST_ID)""")
def ecl_top5(spark, sf):
    return ecl.top_loans(_loss(spark, sf), view(spark, sf, "v_customers"))


@R.query("ecl_unknowns", MODEL_SQL + """
    SELECT 'rating' AS kind, RATING AS value, count(*) AS loans FROM loss WHERE unknown_rating GROUP BY 2
    UNION ALL SELECT 'facility', FACILITY_TYPE, count(*) FROM loss WHERE unknown_facility GROUP BY 2""")
def ecl_unknowns(spark, sf):
    return ecl.unknown_values(_loss(spark, sf))


@R.query("ecl_params_used", MODEL_SQL + """
    SELECT 'pd' AS kind, CAST(rank AS INT) AS rank, RATING AS value, pd0 AS parameter, count(*) AS loans FROM loss WHERE NOT unknown_rating GROUP BY 2, 3, 4
    UNION ALL SELECT 'lgd', 0, FACILITY_TYPE, lgd, count(*) FROM loss GROUP BY 3, 4""")
def ecl_params_used(spark, sf):
    return ecl.parameters_used(_loss(spark, sf))


@R.query("ecl_agreement", MODEL_SQL + f"""
    SELECT round(count(*) FILTER (WHERE STAGE = computed_stage) / count(*)::DOUBLE, 4) AS stage_agreement,
           {AMOUNT(TOTAL('ECL_SAR'))} AS stated_ecl, {AMOUNT(TOTAL('ecl_base'))} AS computed_ecl,
           abs({TOTAL('ECL_SAR')}::DOUBLE - {TOTAL('ecl_base')}::DOUBLE) < greatest(1::DOUBLE, {TOTAL('ECL_SAR')}::DOUBLE * 0.001::DOUBLE) AS matches_source FROM loss""")
def ecl_agreement(spark, sf):
    return ecl.source_agreement(_loss(spark, sf))


@R.query("ecl_simple", f"""
    SELECT count(*) AS loan_count, {AMOUNT(TOTAL('EAD'))} AS total_ead, {AMOUNT(TOTAL('PD * LGD * EAD'))} AS total_ecl,
           round({TOTAL('PD * LGD * EAD')}::DOUBLE / {TOTAL('EAD')}::DOUBLE, 4) AS coverage_ratio, {AMOUNT(TOTAL('ECL_SAR'))} AS stated_ecl,
           abs({TOTAL('ECL_SAR')}::DOUBLE - {TOTAL('PD * LGD * EAD')}::DOUBLE) < greatest(1::DOUBLE, {TOTAL('ECL_SAR')}::DOUBLE * 0.001::DOUBLE) AS matches_source
    FROM v_loans""")
def ecl_simple(spark, sf):
    return ecl.simple(view(spark, sf, "v_loans").drop("RATING"))


@R.query("ecl_simple_stages", "SELECT STAGE AS stage, count(*) AS loans FROM v_loans GROUP BY 1")
def ecl_simple_stages(spark, sf):
    return ecl.simple_stages(view(spark, sf, "v_loans"))


_TRIGGERS = ("days past due backstop (30/90 days)", *[t[0] for t in ecl.TRIGGERS], "two-notch rating downgrade")
_FIRED = {0: ("'DPD'", "count(*) FILTER (WHERE DPD >= 30)"), 1: ("'WATCHLIST'", "count(*) FILTER (WHERE WATCHLIST)")}


@R.query("ecl_triggers", " UNION ALL ".join(
    f"SELECT {i} AS trigger_no, '{t}' AS trigger, {_FIRED.get(i, ('NULL', ''))[0]} AS column_used, {i in _FIRED} AS evaluated, {_FIRED.get(i, ('', 'NULL::BIGINT'))[1]} AS loans FROM "
    + ("v_loans" if i in _FIRED else "(SELECT 1)") for i, t in enumerate(_TRIGGERS)))
def ecl_triggers(spark, sf):
    return ecl.triggers(view(spark, sf, "v_loans"))


# Exposures of 10^11 to 10^12: many loans are beyond the millionths that fit a long.
_BIG_TOTAL = lambda x: (f"(CAST(coalesce(sum(CAST(floor(CASE WHEN abs({x}) < 1e12 THEN ({x}) * 1e6::DOUBLE + 0.5::DOUBLE END) AS DECIMAL(18,0))), 0) AS HUGEINT)"
                        f" + CAST(coalesce(sum(CAST(CASE WHEN abs({x}) >= 1e12 THEN ({x}) * 1e6::DOUBLE END AS DECIMAL(38,0))), 0) AS HUGEINT))")


@R.query("ecl_large_amounts", MODEL_SQL.replace("SELECT l.* EXCLUDE (PD, LGD)", "SELECT l.* EXCLUDE (PD, LGD) REPLACE (EAD * 1e7::DOUBLE AS EAD)") + f"""
    SELECT count(*) AS loan_count, round(CAST({_BIG_TOTAL('EAD')} AS DOUBLE) / 1e6::DOUBLE) AS total_ead, round(CAST({_BIG_TOTAL('ecl_base')} AS DOUBLE) / 1e6::DOUBLE) AS total_ecl FROM loss""")
def ecl_large_amounts(spark, sf):
    loans = view(spark, sf, "v_loans")
    out = ecl.totals(ecl.per_loan(loans.withColumn("EAD", loans["EAD"] * 1e7)))
    return out.select("loan_count", F.round("total_ead").alias("total_ead"), F.round("total_ecl").alias("total_ecl"))


@R.query("ecl_agreement_partial", MODEL_SQL + f"""
    SELECT CAST(NULL AS DOUBLE) AS stage_agreement, {AMOUNT(TOTAL('ECL_SAR'))} AS stated_ecl, {AMOUNT(TOTAL('ecl_base'))} AS computed_ecl,
           abs({TOTAL('ECL_SAR')}::DOUBLE - {TOTAL('ecl_base')}::DOUBLE) < greatest(1::DOUBLE, {TOTAL('ECL_SAR')}::DOUBLE * 0.001::DOUBLE) AS matches_source FROM loss
    UNION ALL SELECT round(count(*) FILTER (WHERE STAGE = computed_stage) / count(*)::DOUBLE, 4), NULL, {AMOUNT(TOTAL('ecl_base'))}, NULL FROM loss""")
def ecl_agreement_partial(spark, sf):
    """Files that state the loss or the stage alone."""
    return ecl.source_agreement(_loss(spark, sf).drop("STAGE")).unionByName(ecl.source_agreement(_loss(spark, sf).drop("ECL_SAR")))


@R.query("ecl_top5_from_silver", MODEL_SQL + """
    , t AS (SELECT LOAN_ID, CUST_ID, ecl_base FROM loss ORDER BY ecl_base DESC NULLS LAST, LOAN_ID, CUST_ID LIMIT 5),
    c AS (SELECT CUST_ID, arg_max(FULL_NAME, row_pos) AS nm FROM v_customers GROUP BY 1)
    SELECT t.LOAN_ID AS id, round(t.ecl_base, 2) AS ecl, coalesce(c.nm, 'unnamed record') AS name FROM t LEFT JOIN c USING (CUST_ID)""")
def ecl_top5_from_silver(spark, sf):
    """Names from the engine's own Silver, whose rows are placed by ``_row_pos``."""
    customers = prof.to_silver(view(spark, sf, "v_customers").withColumnRenamed("row_pos", "_row_pos").drop("dataset"))
    return ecl.top_loans(_loss(spark, sf), customers)
