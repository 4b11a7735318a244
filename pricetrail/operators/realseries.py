"""Fixed-base relatives, monthly means, constant prices and linked vintages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetrail.functions.exact import exact_mean, fraction, inverse, lowest_terms, mean_micros, ratio_micros, rounded, sum_of, times
from pricetrail.functions.reasons import duplicated, failed, stacked, violations

LINE = ["mpn", "seller"]


def dated_lines(qualified: DataFrame) -> DataFrame:
    """One row per line and UTC date: eligible price if there is one, else its reasons.

    Several rows of one line-date fold to the smallest eligible id; the append
    audit reports them.
    """
    row = F.struct((F.col("status") != "eligible").alias("bad"), "observation_id", "amount_minor", "reasons")
    return qualified.groupBy(*LINE, F.to_date("observed_at").alias("date")).agg(F.min(row).alias("r")).select(
        *LINE, "date", (~F.col("r.bad")).alias("eligible"), "r.observation_id", "r.amount_minor", "r.reasons"
    )


#: Statuses of a line on a date, by whether it has an eligible price on the base date.
UNBASED = ("no_baseline_observation", "baseline_ineligible")
BASED = ("eligible_paired_line", "missing_current_observation_no_imputation", "current_observation_ineligible_no_imputation")


def coverage_runs(daily: DataFrame, base_date: str) -> DataFrame:
    """Status of every line from its first appearance to the last date, as runs of days.

    (line, start_date, end_date, status, reasons, last_eligible_date,
    base_observation_id, current_observation_id). A line without an eligible base
    price is one run; of any other line each dated row is a run of one day, and
    the days up to the next row are a run without an observation. Rows grow with
    the observations, not with lines x dates. The window's rows are a line's own,
    bounded by the calendar.
    """
    base = F.lit(base_date).cast("date")
    last = daily.agg(F.max("date")).scalar()
    line = Window.partitionBy(*LINE)
    running = line.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    at_base = F.max(F.when(F.col("date") == base, F.struct("eligible", "observation_id", "reasons"))).over(line)
    rows = daily.withColumns({
        "at_base": at_base, "first_seen": F.min("date").over(line), "next_date": F.lead("date").over(line.orderBy("date")),
        "upto": F.last(F.when(F.col("eligible"), F.col("date")), ignorenulls=True).over(running),
    })
    none = F.lit(None).cast("date"), F.lit(None).cast("string")
    run = lambda start, end, status, reasons, prior, now: F.struct(
        start.alias("start_date"), end.alias("end_date"), F.lit(status).alias("status"), reasons.alias("reasons"),
        prior.alias("last_eligible_date"), now.alias("current_observation_id"),
    )
    texts = lambda *t: F.array(*map(F.lit, t)).cast("array<string>")
    own = F.when(F.col("eligible"), run(F.col("date"), F.col("date"), BASED[0], texts(), none[0], F.col("observation_id"))).otherwise(
        run(F.col("date"), F.col("date"), BASED[2], F.col("reasons"), none[0], F.col("observation_id"))
    )
    until = F.coalesce(F.date_sub("next_date", 1), last)
    gap = F.when(until > F.col("date"), run(F.date_add("date", 1), until, BASED[1], texts("no_same_date_observation"), F.col("upto"), none[1]))
    unbased = F.when(F.col("date") == F.col("first_seen"), F.when(
        F.col("at_base").isNull(), run(F.col("date"), last, UNBASED[0], texts("no_observation_on_immutable_base_date"), *none)
    ).otherwise(run(F.col("date"), last, UNBASED[1], F.col("at_base.reasons"), *none)))
    based = F.coalesce(F.col("at_base.eligible"), F.lit(False))
    held = F.array_compact(F.when(based, F.array(own, gap)).otherwise(F.array(unbased)))
    out = rows.select(*LINE, F.when(based, F.col("at_base.observation_id")).alias("base_observation_id"), F.explode(held).alias("run"))
    return out.select(*LINE, "run.start_date", "run.end_date", "run.status", "run.reasons", "run.last_eligible_date", "base_observation_id", "run.current_observation_id")


def observed_days(daily: DataFrame) -> DataFrame:
    """(day, seen, seen_sum) for every day from before the first date on: dates observed up to it, and the sum of their day numbers."""
    number = F.unix_date("date")
    dates = daily.select("date").distinct()
    span = dates.agg(F.date_sub(F.min("date"), 1).alias("a"), F.max("date").alias("z")).where("a IS NOT NULL")
    days = span.select(F.explode(F.sequence("a", "z", F.expr("INTERVAL 1 DAY"))).alias("day"))
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    j = days.join(dates, F.col("day") == F.col("date"), "left")
    return j.select("day", F.count("date").over(upto).alias("seen"), F.coalesce(F.sum(number).over(upto), F.lit(0)).alias("seen_sum"))


def run_dates(runs: DataFrame, days: DataFrame) -> DataFrame:
    """Runs with the number of observed dates in them, and the days since the last eligible price, summed over those dates."""
    at = lambda name: days.select(F.col("day").alias(f"{name}_day"), F.col("seen").alias(f"{name}_seen"), F.col("seen_sum").alias(f"{name}_sum"))
    j = runs.join(at("before"), F.date_sub("start_date", 1) == F.col("before_day")).join(at("upto"), F.col("end_date") == F.col("upto_day"))
    n = F.col("upto_seen") - F.col("before_seen")
    stale = F.col("upto_sum") - F.col("before_sum") - n * F.unix_date("last_eligible_date")
    return j.select(*runs.columns, n.alias("date_count"), stale.alias("stale_days"))


def coverage_by_date(runs: DataFrame, daily: DataFrame) -> DataFrame:
    """Lines in each status per observed date, and the paired share of the whole base.

    Runs fold to one count per first and one per day after the last before they
    are summed along the dates. The windows have one row per date.
    """
    names = [*BASED, *UNBASED]
    change = F.explode(F.array(F.struct(F.col("start_date").alias("date"), F.lit(1).alias("n")), F.struct(F.date_add("end_date", 1).alias("date"), F.lit(-1).alias("n"))))
    moves = runs.select("status", change.alias("c")).groupBy("c.date").agg(*[F.sum(F.when(F.col("status") == s, F.col("c.n")).otherwise(0)).alias(s) for s in names])
    dates = daily.select(F.col("date").alias("observed")).distinct()
    upto = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    j = moves.join(dates, F.col("date") == F.col("observed"), "full").withColumn("at", F.coalesce("date", "observed"))
    per = j.select("at", "observed", *[F.sum(s).over(upto).alias(s) for s in names]).where("observed IS NOT NULL")
    per = per.select(F.col("observed").alias("date"), *[F.coalesce(F.col(s), F.lit(0)).alias(f"{s}_count") for s in names])
    lines = sum((F.col(f"{s}_count") for s in BASED[1:]), F.col(f"{BASED[0]}_count"))
    return with_quality(per.withColumn("baseline_eligible_line_count", lines))


def base_coverage(daily: DataFrame, base_date: str) -> DataFrame:
    """The runs laid out: status of every line on every observed date from its first appearance on.

    Ids and reasons are not carried, so `daily` need not have them.
    """
    plain = daily.select(*LINE, "date", "eligible", F.lit(None).cast("string").alias("observation_id"), F.lit(None).cast("array<string>").alias("reasons"))
    runs = coverage_runs(plain, base_date)
    dates = daily.select("date").distinct()
    full = runs.withColumn("date", F.explode(F.sequence("start_date", "end_date", F.expr("INTERVAL 1 DAY")))).join(dates, "date")
    return full.select(*LINE, "date", "status", "last_eligible_date", F.date_diff("date", "last_eligible_date").cast("long").alias("stale_days"))


def with_quality(per: DataFrame) -> DataFrame:
    """Paired share of the whole base in basis points, half-up, and the state of the date.

    Every base line is counted from its first day to the last, so the base holds
    as many lines as its fullest date. The window has one row per date.
    """
    per = per.withColumn("baseline_eligible_line_count", F.max("baseline_eligible_line_count").over(Window.partitionBy()))
    n, d = F.col("eligible_paired_line_count"), F.col("baseline_eligible_line_count")
    bp = F.when(d == 0, F.lit(0)).otherwise(F.floor((n * 20000 + d) / (d * 2)))
    quality = (
        F.when((d > 0) & (n == d), F.lit("calculable_complete_base_basket_without_imputation"))
        .when(n > 0, F.lit("abstain_incomplete_base_basket_coverage"))
        .otherwise(F.lit("abstain_no_eligible_paired_lines"))
    )
    return per.withColumns({"coverage_basis_points": bp.cast("long"), "quality_state": quality})


def base_coverage_by_date(coverage: DataFrame) -> DataFrame:
    """The share per date of a coverage that is laid out."""
    return with_quality(coverage.groupBy("date").agg(
        F.count_if(F.col("status").isin(*BASED)).alias("baseline_eligible_line_count"),
        F.count_if(F.col("status") == BASED[0]).alias("eligible_paired_line_count"),
    ))


def complete_relatives(daily: DataFrame, base_date: str) -> DataFrame:
    """(date, amount_minor, base_minor, n) of the dates on which every base line is present.

    Presence is counted, not enumerated: a date is complete when as many base
    lines met on it as the base holds. Relatives fold to (numerator,
    denominator, count).
    """
    eligible = daily.where("eligible")
    base = eligible.where(F.col("date") == F.lit(base_date).cast("date")).select(*LINE, F.col("amount_minor").alias("base_minor"))
    size = base.agg(F.count(F.lit(1))).scalar()
    paired = eligible.join(base, LINE).groupBy("date", "amount_minor", "base_minor").agg(F.count(F.lit(1)).alias("n"))
    complete = paired.groupBy("date").agg(F.sum("n").alias("line_count")).where(F.col("line_count") == size)
    return paired.join(complete.select("date"), "date", "left_semi")


def fixed_base_levels(daily: DataFrame, base_date: str) -> DataFrame:
    """Mean price relative to the base date in micros, exact before its one rounding."""
    levels = mean_micros(complete_relatives(daily, base_date), "date", "amount_minor", "base_minor", "n")
    return levels.select("date", F.col("count").alias("eligible_line_count"), "level_micros")


def fixed_base_terms(daily: DataFrame, base_date: str) -> DataFrame:
    """The exact sum of a date's relatives: fractions in lowest terms, one per denominator."""
    return lowest_terms(complete_relatives(daily, base_date), "date", "amount_minor", "base_minor", "n")


def fixed_base_relative(daily: DataFrame, base_date: str) -> DataFrame:
    """The levels with their exact value written out as one fraction."""
    means = exact_mean(complete_relatives(daily, base_date), "date", "amount_minor", "base_minor", "n")
    return means.select("date", F.col("count").alias("eligible_line_count"), "level_num", "level_den", "level_micros")


def monthly_complete_mean(daily: DataFrame, contracts: DataFrame) -> DataFrame:
    """Month value only where every required date is present.

    `daily` is (date, value decimal), `contracts` (month, required_date) as
    rows. `exact` is the mean as a fraction, `value` the same to ten decimals.
    Absent dates are counted here and listed by `missing_contract_dates`.
    """
    j = contracts.join(daily.withColumnRenamed("date", "required_date"), "required_date", "left")
    per = j.groupBy("month").agg(
        F.count(F.lit(1)).alias("required"), F.count("value").alias("present"), F.sum("value").alias("total")
    )
    complete = F.col("required") == F.col("present")
    exact = fraction(in_units(F.col("total"), 10), F.col("present") * 10**10)
    return per.select(
        "month",
        F.when(complete, F.lit("AVAILABLE")).otherwise(F.lit("UNAVAILABLE_MONTH_INCOMPLETE")).alias("quality_state"),
        F.when(complete, (rounded(exact, 10) * F.lit("1e-10").cast("decimal(10,10)")).cast("decimal(38,10)")).alias("value"),
        (F.col("required") - F.col("present")).alias("missing_date_count"),
        F.when(complete, exact).alias("exact"),
    )


def in_units(value: Column, places: int) -> Column:
    """A decimal as an integer in units of its last place."""
    return (value.cast(f"decimal(38,{places})") * F.lit(10**places).cast("decimal(11,0)")).cast("decimal(38,0)")


def missing_contract_dates(daily: DataFrame, contracts: DataFrame) -> DataFrame:
    return contracts.join(daily, contracts["required_date"] == daily["date"], "left_anti")


def check_contracts(contracts: DataFrame) -> DataFrame:
    """Required dates outside their month or stated twice."""
    return stacked(
        violations(contracts, F.concat_ws("|", "month", F.col("required_date").cast("string")), [
            ("required_date_in_other_month", F.date_format("required_date", "yyyy-MM") != F.col("month")),
        ]),
        duplicated(contracts, ["month", "required_date"], "required_date_not_unique"),
    )


def reference_level(months: DataFrame, reference_months: DataFrame) -> DataFrame:
    """Mean over the reference months, one row, `exact` as a fraction; unavailable if any of them is.

    The months of a reference are a stated list; their values meet in one row.
    """
    j = reference_months.join(months.select("month", "exact"), "month", "left")
    n, have = F.col("n"), F.col("have")
    row = j.agg(F.count(F.lit(1)).alias("n"), F.count("exact").alias("have"), F.collect_list("exact").alias("values"))
    mean = times(sum_of(F.col("values")), F.struct(F.lit(1).cast("decimal(38,0)").alias("num"), n.cast("decimal(38,0)").alias("den")))
    full = (n == have) & (n > 0)
    out = row.select("n", "have", F.when(full, mean).alias("exact"))
    return out.select(
        F.when(n == have, F.lit("AVAILABLE")).otherwise(F.lit("UNAVAILABLE_HISTORICAL_REFERENCE_INPUT")).alias("quality_state"),
        (rounded(F.col("exact"), 10) * F.lit("1e-10").cast("decimal(10,10)")).cast("decimal(38,10)").alias("value"),
        (n - have).alias("missing_month_count"), "exact",
    )


def rebase_100(months: DataFrame, level: DataFrame) -> DataFrame:
    """100 x month / reference: `exact` as a fraction, `value` to six decimals, half-up of the exact value."""
    hundred = F.struct(F.lit(100).cast("decimal(38,0)").alias("num"), F.lit(1).cast("decimal(38,0)").alias("den"))
    known = F.col("exact").isNotNull() & F.col("reference").isNotNull() & (F.col("reference.num") > 0)
    j = months.select("month", "exact").withColumn("reference", level.select("exact").scalar())
    j = j.select("month", F.when(known, times(times(hundred, F.col("exact")), inverse(F.col("reference")))).alias("exact"))
    return j.select(
        "month",
        F.when(F.col("exact").isNotNull(), F.lit("AVAILABLE")).otherwise(F.lit("UNAVAILABLE_HISTORICAL_REFERENCE_INPUT")).alias("quality_state"),
        (rounded(F.col("exact"), 6).cast("double") / 1000000).alias("value"), "exact",
    )


def check_deflator(release: DataFrame, release_vintage_id: str) -> DataFrame:
    """One release only, months and values valid, no month twice, lineage present."""
    return stacked(
        violations(release, F.col("month"), [
            ("mixed_release_vintage_observation", failed(F.col("release_vintage_id") != release_vintage_id)),
            ("observation_lineage_incomplete",
             failed(~F.col("month").rlike("^[0-9]{4}-(0[1-9]|1[0-2])$")) | failed(F.length("observation_status") == 0)),
            ("deflator_value_not_positive", failed(F.col("value") <= 0)),
        ]),
        duplicated(release, ["month"], "duplicate_observation_month"),
    )


def check_deflator_release(releases: DataFrame) -> DataFrame:
    """Where a release comes from, one row each: (release_id, release_date, retrieved_at, capture_sha256, parser_version,
    provider, series_code, title, adjustment_status, frequency, unit, canonical_source_url), all as text."""
    def blank(name: str) -> Column:
        return failed(F.length(F.trim(name)) == 0)

    return violations(releases, F.col("release_id"), [
        ("release_id_missing", blank("release_id")),
        ("release_date_malformed", failed(~F.col("release_date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"))),
        ("retrieved_at_not_utc", failed(~F.col("retrieved_at").endswith("Z"))),
        ("capture_not_digest", failed(~F.col("capture_sha256").rlike("^[0-9a-f]{64}$"))),
        ("parser_version_missing", blank("parser_version")),
        *[(f"series_{name}_missing", blank(name)) for name in ("provider", "series_code", "title", "adjustment_status")],
        ("series_not_monthly_index", failed((F.col("frequency") != "monthly") | (F.col("unit") != "index_points"))),
        ("series_source_not_https", failed(~F.col("canonical_source_url").startswith("https://"))),
    ])


def constant_price(months: DataFrame, deflator: DataFrame, reference_month: str) -> DataFrame:
    """Nominal x deflator(reference) / deflator(month), with why a month is missing.

    `exact` is a fraction, `value` the same to four decimals, half-up of the
    exact value. Deflators are read as decimals of six places. A month the
    release states more than once has no deflator, as the reference month too.
    """
    per = deflator.groupBy("month").agg(F.count(F.lit(1)).alias("times"), F.max("value").alias("value"))
    usable = (F.col("times") == 1) & (F.col("value") > 0)
    per = per.select(F.col("month").alias("of"), "times", F.when(usable, fraction(in_units(F.col("value"), 6), F.lit(10**6))).alias("deflator"))
    reference = per.where(F.col("of") == reference_month).select("deflator").scalar()
    j = months.select("month", F.col("exact").alias("nominal")).join(per, F.col("month") == F.col("of"), "left").withColumn("reference", reference)
    reason = (
        F.when(F.col("nominal").isNull(), F.lit("monthly_nominal_unavailable"))
        .when(F.col("times") > 1, F.lit("duplicate_observation_month"))
        .when(F.col("reference").isNull(), F.lit("constant_price_reference_month_missing"))
        .when(F.col("deflator").isNull(), F.lit("observation_month_missing"))
    )
    j = j.withColumn("unavailable_reason", reason)
    real = times(times(F.col("nominal"), F.col("reference")), inverse(F.col("deflator")))
    j = j.select("month", "unavailable_reason", F.when(F.col("unavailable_reason").isNull(), real).alias("exact"))
    return j.select("month", (rounded(F.col("exact"), 4).cast("double") / 10000).alias("value"), "unavailable_reason", "exact")


def revision_impact(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """Later minus earlier value per month of the later revision."""
    j = later.select("month", F.col("value").alias("now")).join(earlier.select("month", F.col("value").alias("was")), "month", "left")
    impact = F.col("now") - F.col("was")
    return j.select(
        "month", F.round(impact, 4).alias("impact"),
        F.when(impact.isNotNull(), F.lit("AVAILABLE_ADDITIVE_IMPACT"))
        .otherwise(F.lit("UNAVAILABLE_REVISION_COMPARISON_INPUT")).alias("quality_state"),
    )


def link_factor(overlap: DataFrame) -> DataFrame:
    """Prior over candidate value on the first overlap date, one row."""
    first = F.min(F.struct("date", "prior_value", "candidate_value")).alias("first")
    return overlap.where("quality_state = 'AVAILABLE'").agg(first).select(
        F.col("first.date").alias("overlap_date"),
        F.col("first.prior_value").alias("factor_num"), F.col("first.candidate_value").alias("factor_den"),
    )


def link_vintage(prior: DataFrame, candidate: DataFrame, overlap: DataFrame, effective_from: str) -> DataFrame:
    """Prior points, then the candidate's scaled points as a new segment.

    Points are (segment_no, date, state, value); the candidate has no segment
    number yet. Unavailable points stay null. Values are integers in micros and
    the product is exact before its one half-up rounding.
    """
    row = link_factor(overlap).select(F.struct("factor_num", "factor_den").alias("f")).scalar()
    segment = prior.agg(F.coalesce(F.max("segment_no"), F.lit(0)) + 1).scalar()
    linked = candidate.where(F.col("date") >= F.lit(effective_from).cast("date")).select(
        segment.cast("long").alias("segment_no"), "date", "state",
        F.when(F.col("state") == "AVAILABLE", ratio_micros(F.col("value"), row.getField("factor_num"), row.getField("factor_den"))).alias("value"),
    )
    return stacked(prior.select("segment_no", "date", "state", "value"), linked)


def check_overlap(overlap: DataFrame) -> DataFrame:
    """Overlap dates once each, available, both values positive."""
    return stacked(
        violations(overlap, F.col("date"), [
            ("overlap_not_available", failed(F.col("quality_state") != "AVAILABLE")),
            ("overlap_value_not_positive", failed((F.col("prior_value") <= 0) | (F.col("candidate_value") <= 0))),
        ]),
        duplicated(overlap, ["date"], "overlap_date_not_unique"),
    )


def check_prefix(prior: DataFrame, effective_from: str) -> DataFrame:
    """Prior points strictly before the boundary, dated once, valued when available."""
    available = F.col("state") == "AVAILABLE"
    value_ok = F.when(available, F.coalesce(F.col("value") > 0, F.lit(False))).otherwise(F.col("value").isNull())
    return stacked(
        violations(prior, F.col("date"), [
            ("point_not_before_boundary", failed(F.col("date") >= F.lit(effective_from).cast("date"))),
            ("point_value_malformed", ~value_ok),
        ]),
        duplicated(prior, ["date"], "point_date_not_unique"),
    )
