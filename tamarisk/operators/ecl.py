"""Expected credit loss over a loan table.

The per-loan step is one narrow stage: two broadcast parameter lookups (10 and 6 rows, fixed
by the methodology) and codegen expressions. Every report is one partial aggregate on top,
so the only rows shuffled are group totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk import params as P
from tamarisk.functions import credit as C
from tamarisk.functions.text import flag
from tamarisk.operators import roles
from tamarisk.session import materialise

# trigger: (column names looked for, stage it forces)
TRIGGERS = (
    ("watchlist flag", ("watchlist",), 2),
    ("borrower-requested restructuring flag", ("restructure_request", "restructuring_requested"), 2),
    ("formally restructured flag", ("restructured", "restructuring"), 3),
    ("legal proceedings initiated flag", ("legal_proceedings", "legal_action"), 3),
    ("formal default flag", ("formal_default", "default_flag", "is_default"), 3),
)


def _trigger_column(columns, names, substring_match: bool) -> str | None:
    return roles.find_containing(columns, names) if substring_match else roles.find_exact(columns, names)


def staged(df: DataFrame, substring_match: bool = False) -> Column:
    """Stage from days past due, lifted by whichever trigger columns the file has."""
    types = dict(df.dtypes)
    stage = C.dpd_stage(F.col("DPD"))
    for _, names, forced in TRIGGERS:
        found = _trigger_column(df.columns, names, substring_match)
        if found:
            stage = F.when(flag(F.col(found), types[found]), F.greatest(stage, F.lit(forced))).otherwise(stage)
    return stage


def triggers(df: DataFrame, substring_match: bool = False) -> DataFrame:
    """Which staging triggers this table's columns let us evaluate, and on how many loans each fires."""
    types = dict(df.dtypes)
    entries = [("days past due backstop (30/90 days)", "DPD", F.col("DPD") >= 30)]
    for label, names, _ in TRIGGERS:
        found = _trigger_column(df.columns, names, substring_match)
        entries.append((label, found, flag(F.col(found), types[found]) if found else None))
    entries.append(("two-notch rating downgrade", None, None))  # needs a rating at origination
    one = df.agg(F.count("*").alias("n"), *[F.count_if(hit).alias(f"t{i}") for i, (_, _, hit) in enumerate(entries) if hit is not None])
    rows = F.array(*[F.struct(F.lit(i).alias("trigger_no"), F.lit(label).alias("trigger"), F.lit(column).cast("string").alias("column_used"),
                              F.lit(hit is not None).alias("evaluated"), (F.col(f"t{i}") if hit is not None else F.lit(None).cast("bigint")).alias("loans"))
                     for i, (label, column, hit) in enumerate(entries)])
    return one.select(F.inline(rows))


def rating_table(spark) -> DataFrame:
    return P.inline_table(spark, "rating_key, rating_rank, rating_pd", [(k, i, v) for i, (k, v) in enumerate(P.PD_BY_RATING.items())])


def facility_table(spark) -> DataFrame:
    return P.inline_table(spark, "facility_key, facility_lgd", list(P.LGD_BY_FACILITY.items()))


def _one_row_each(given: DataFrame, key: str) -> DataFrame:
    """A given parameter table: a repeated key would repeat its loans. Its size is the planner's to judge."""
    if not given.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} is repeated in the given parameters")
    return given


def per_loan(loans: DataFrame, reporting_date: str = P.REPORTING_DATE, ratings: DataFrame | None = None,
             facilities: DataFrame | None = None, substring_match: bool = False) -> DataFrame:
    """Loans with unknown flags, stage, effective PD, LGD and one loss per scenario.

    ``ratings``/``facilities`` replace the stated tables by fitted ones of the same shape
    (one row per grade or facility), which is how the trained mode is run.
    """
    missing = [c for c in P.MODELLING_COLUMNS if c not in loans.columns]
    if missing:
        raise ValueError(f"missing modelling columns: {missing}")
    spark = loans.sparkSession
    ratings = F.broadcast(rating_table(spark)) if ratings is None else _one_row_each(ratings, "rating_key")
    facilities = F.broadcast(facility_table(spark)) if facilities is None else _one_row_each(facilities, "facility_key")
    default_pd = P.PD_BY_RATING[P.DEFAULT_RATING]
    out = (
        loans.join(ratings, F.col("RATING") == F.col("rating_key"), "left")
        .join(facilities, F.col("FACILITY_TYPE") == F.col("facility_key"), "left")
        .withColumn("unknown_rating", F.col("rating_key").isNull())
        .withColumn("unknown_facility", F.col("facility_key").isNull())
        .withColumn("computed_stage", staged(loans, substring_match))
        .withColumn("start_pd", F.coalesce("rating_pd", F.lit(default_pd)))
        .withColumn("term_years", C.remaining_years(F.col("MATURITY"), reporting_date, dict(loans.dtypes)["MATURITY"]))
        .withColumn("effective_pd", F.when(F.col("computed_stage") > 1, C.lifetime_pd(F.col("start_pd"), F.col("term_years")))
                    .otherwise(F.col("start_pd")))
        .withColumn("effective_lgd", F.coalesce("facility_lgd", F.lit(P.DEFAULT_LGD)))
    )
    for s in P.SCENARIOS:
        out = out.withColumn(f"ecl_{s}", C.scenario_loss(F.col("effective_pd"), F.col("effective_lgd"), F.col("EAD"), s))
    return out


def ecl_column(scenario: str) -> str:
    if scenario not in P.SCENARIOS:
        raise ValueError(f"unknown scenario '{scenario}'; choose one of {sorted(P.SCENARIOS)}")
    return f"ecl_{scenario}"


def totals(loss: DataFrame, scenario: str = "base") -> DataFrame:
    ecl, ead = C.total(F.col(ecl_column(scenario))), C.total(F.col("EAD"))
    return loss.agg(F.count("*").alias("loan_count"), ead.alias("e"), ecl.alias("l")).select(
        "loan_count", C.amount(F.col("e")).alias("total_ead"), C.amount(F.col("l")).alias("total_ecl"),
        F.round(F.col("l").cast("double") / F.nullif(F.col("e").cast("double"), F.lit(0.0)), 4).alias("coverage_ratio"),
    )


def by_stage(loss: DataFrame, scenario: str = "base") -> DataFrame:
    return loss.groupBy(F.col("computed_stage").alias("stage")).agg(
        F.count("*").alias("loans"), C.amount(C.total(F.col("EAD"))).alias("ead"),
        C.amount(C.total(F.col(ecl_column(scenario)))).alias("ecl"))


def by_scenario(loss: DataFrame) -> DataFrame:
    """One row per scenario: three conditional totals in a single pass, then unpivoted."""
    one = loss.agg(*[C.total(F.col(f"ecl_{s}")).alias(s) for s in P.SCENARIOS])
    rows = F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(w).alias("weight"), C.amount(F.col(s)).alias("ecl"))
                     for s, (_, _, w) in P.SCENARIOS.items()])
    return one.select(F.inline(rows))


def expected(loss: DataFrame) -> DataFrame:
    one = loss.agg(*[C.total(F.col(f"ecl_{s}")).alias(s) for s in P.SCENARIOS])
    blend = sum((F.col(s) * F.lit(str(w)).cast("decimal(4,2)") for s, (_, _, w) in P.SCENARIOS.items()), F.lit(0))
    return one.select(C.amount(blend).alias("expected_ecl"))


def weighted_pd_lgd(loss: DataFrame) -> DataFrame:
    pd, lgd, ead = (C.total(F.col("effective_pd") * F.col("EAD")), C.total(F.col("effective_lgd") * F.col("EAD")), C.total(F.col("EAD")))
    one = loss.agg(pd.alias("p"), lgd.alias("g"), ead.alias("e"))
    share = lambda c: F.col(c).cast("double") / F.nullif(F.col("e").cast("double"), F.lit(0.0))
    return one.select(F.round(share("p"), 6).alias("avg_pd"), F.round(share("g"), 4).alias("avg_lgd"))


def stage_counts(loss: DataFrame) -> DataFrame:
    return loss.agg(*[F.count_if(F.col("computed_stage") == s).alias(f"stage_{s}_count") for s in (1, 2, 3)])


def top_loans(loss: DataFrame, customers: DataFrame | None = None, k: int = 5, scenario: str = "base") -> DataFrame:
    """The k largest losses, named from the customer file (the last duplicate id wins).

    The top-k runs first, so the customer file is only filtered by k ids (an inner join
    against k rows) before its duplicates are resolved; it is never shuffled whole.
    """
    name = roles.find_containing(loss.columns, P.NAME_CANDIDATES)
    ident = roles.find_containing(loss.columns, ("loan_id", "national_id", "cust_id", "customer_id", "id"))
    key = roles.find_exact(loss.columns, ("cust_id",))
    ecl = F.col(ecl_column(scenario))
    position = "_row_pos" if "_row_pos" in loss.columns else None
    keep = [c for c in dict.fromkeys([ident, name, key, position]) if c]
    top = loss.select(*keep, ecl.alias("loss")).orderBy(F.desc_nulls_last("loss"), *keep).limit(k)
    if customers is not None and key is not None:
        top = materialise(top)  # k rows used twice below; the loans are read once
    own_name = F.col(name).cast("string") if name else F.lit(None).cast("string")
    unnamed = F.concat(F.lit("Record "), F.col(position).cast("string")) if position else F.lit("unnamed record")
    if customers is None or key is None:
        return top.select(F.col(ident).cast("string").alias("id"), F.round("loss", 2).alias("ecl"),
                          F.coalesce(own_name, unnamed).alias("name"))
    place = next((c for c in ("_row_pos", "row_pos") if c in customers.columns), None)
    cust_key = roles.find_exact(customers.columns, ("cust_id",))
    cust_name = roles.find_exact(customers.columns, ("full_name", "name", "customer_name"))
    wanted = top.select(F.col(key).cast("string").alias("_key")).distinct()
    names = (
        customers.select(F.col(cust_key).cast("string").alias("_key"), F.col(cust_name).alias("_name"), (F.col(place) if place else F.lit(0)).alias("_place"))
        .where(F.col("_key").isNotNull() & F.col("_name").isNotNull())
        .join(F.broadcast(wanted), "_key")
        .groupBy("_key").agg(F.max_by("_name", F.struct("_place", "_name")).alias("_name"))
    )
    return top.join(F.broadcast(names), F.col(key).cast("string") == F.col("_key"), "left").select(
        F.col(ident).cast("string").alias("id"), F.round("loss", 2).alias("ecl"),
        F.coalesce(F.nullif("_name", F.lit("")), own_name, unnamed).alias("name"))


def unknown_values(loss: DataFrame) -> DataFrame:
    """Distinct ratings and facilities that are not in the parameter tables."""
    rating = F.when(F.col("unknown_rating"), F.struct(F.lit("rating").alias("kind"), F.col("RATING").alias("value")))
    facility = F.when(F.col("unknown_facility"), F.struct(F.lit("facility").alias("kind"), F.col("FACILITY_TYPE").alias("value")))
    return (loss.where(F.col("unknown_rating") | F.col("unknown_facility"))
            .select(F.explode(F.array_compact(F.array(rating, facility))).alias("v"))
            .groupBy("v.kind", "v.value").agg(F.count("*").alias("loans")))


def parameters_used(loss: DataFrame) -> DataFrame:
    """PD per known grade and LGD per facility as actually applied, one pass over the loans."""
    entry = lambda kind, rank, key, value: F.struct(F.lit(kind).alias("kind"), F.col(rank).cast("int").alias("rank") if rank else F.lit(0).alias("rank"),
                                                    F.col(key).alias("value"), F.col(value).alias("parameter"))
    both = F.array(F.when(~F.col("unknown_rating"), entry("pd", "rating_rank", "RATING", "start_pd")),
                   entry("lgd", None, "FACILITY_TYPE", "effective_lgd"))
    return loss.select(F.explode(F.array_compact(both)).alias("v")).groupBy("v.kind", "v.rank", "v.value", "v.parameter").agg(F.count("*").alias("loans"))


def source_agreement(loss: DataFrame, scenario: str = "base") -> DataFrame:
    """Agreement of the computed stage and loss with the figures stated in the file, each where the file has them."""
    given = lambda c: F.col(c) if c in loss.columns else F.lit(None).cast("double")
    same = F.count_if(F.col("STAGE") == F.col("computed_stage")) if "STAGE" in loss.columns else F.lit(None).cast("long")
    one = loss.agg(same.alias("same"), F.count("*").alias("n"), C.total(given("ECL_SAR")).alias("s"), C.total(F.col(ecl_column(scenario))).alias("l"))
    return one.select(F.round(F.col("same") / F.nullif("n", F.lit(0)), 4).alias("stage_agreement"),
                      C.amount(F.col("s")).alias("stated_ecl"), C.amount(F.col("l")).alias("computed_ecl"),
                      _matches(F.col("s").cast("double"), F.col("l").cast("double")).alias("matches_source"))


def _matches(stated: Column, computed: Column) -> Column:
    return F.abs(stated - computed) < F.greatest(F.lit(1.0), stated * 0.001)


def simple(loans: DataFrame) -> DataFrame:
    """Aggregate the PD, LGD and EAD a file already carries."""
    missing = [c for c in ("PD", "LGD", "EAD") if c not in loans.columns]
    if missing:
        raise ValueError(f"missing columns for the loss computation: {missing}")
    sums = [F.count("*").alias("loan_count"), C.total(F.col("EAD")).alias("e"),
            C.total(F.col("PD") * F.col("LGD") * F.col("EAD")).alias("l")]
    stated = "ECL_SAR" in loans.columns
    if stated:
        sums.append(C.total(F.col("ECL_SAR")).alias("s"))
    e, l = F.col("e").cast("double"), F.col("l").cast("double")
    out = ["loan_count", C.amount(F.col("e")).alias("total_ead"), C.amount(F.col("l")).alias("total_ecl"),
           F.round(l / F.nullif(e, F.lit(0.0)), 4).alias("coverage_ratio")]
    if stated:
        out += [C.amount(F.col("s")).alias("stated_ecl"), _matches(F.col("s").cast("double"), l).alias("matches_source")]
    return loans.agg(*sums).select(*out)


def simple_stages(loans: DataFrame) -> DataFrame:
    return loans.groupBy(F.col("STAGE").alias("stage")).agg(F.count("*").alias("loans"))


def assess(loans: DataFrame, **options) -> DataFrame:
    """Modelled totals when all modelling columns exist, else the simple aggregation."""
    return totals(per_loan(loans, **options)) if roles.modelling_ready(loans.columns) else simple(loans)
