"""Activity over time, echo chambers and polarization tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sharelens.functions import numeric as N
from sharelens.session import collect_bounded, hint_small, settle, settle_small

BINS = [-2, -1, 0, 1, 2]
MAX_MONTHS = 5_000


def month_range(df: DataFrame, after: str, before: str, columns: list[str] = ("month",)) -> DataFrame:
    """Months as text, both ends exclusive."""
    for c in columns:
        df = df.where((F.col(c) > after) & (F.col(c) < before))
    return df


def for_list(df: DataFrame, key: str, values: list) -> DataFrame:
    """Rows for exactly the listed keys, in list order; missing ones stay empty."""
    spark = df.sparkSession
    kind = dict(df.dtypes)[key]
    wanted = spark.createDataFrame(list(enumerate(values)), f"__ord long, {key} {kind}")
    kept = df.join(F.broadcast(wanted.select(key)), key, "left_semi")
    return wanted.join(settle_small(kept), key, "left").orderBy("__ord").drop("__ord")


def merge_user_bins(activity: DataFrame) -> DataFrame:
    """User bin 3 counts as 2."""
    user_bin = F.col("last_month_user_bin")
    return activity.withColumn("last_month_user_bin", F.when(user_bin == 3, 2).otherwise(user_bin))


def monthly_counts(activity: DataFrame, scores: DataFrame) -> DataFrame:
    """Comments per (subreddit, month) with the community's score, if any."""
    counts = activity.groupBy("subreddit", "month").agg(F.sum("num_comments").alias("num_comments"))
    named = scores.select(F.col("id").alias("subreddit"), F.col("score").alias("partisan"))
    return counts.join(named, "subreddit", "left")


def score_edges(scores: DataFrame, bins: int = 30, fractions: bool = False) -> Column:
    """Bin edges of scores: ``bins`` even bins, or mean -/+ two sigmas."""
    if fractions:
        edges = F.array(
            F.avg("score") - 2 * F.stddev_pop("score"), F.avg("score") + 2 * F.stddev_pop("score")
        )
        return scores.agg(edges.alias("edges")).scalar()
    ends = scores.agg(F.min("score").alias("low"), F.max("score").alias("high"))
    return ends.select(N.even_edges(F.col("low"), F.col("high"), bins + 1)).scalar()


def activity_shares(activity: DataFrame, scores: DataFrame, bins: int = 30, fractions: bool = False) -> DataFrame:
    """Share of a month's comments per score bin and user bin.

    ``month, user_bin, partisan, share``; user bin 0 stands for all users.
    Communities without a score are left out of shares and totals.
    """
    edges = score_edges(scores, bins, fractions)
    labels = scores.withColumn("edges", edges).select(
        F.col("id").alias("subreddit"), N.digitize(F.col("score"), F.col("edges")).alias("partisan")
    )
    # months x bins rows from here on; settled because totals and shares both read it
    binned = settle(
        merge_user_bins(activity)
        .join(labels, "subreddit")
        .groupBy("partisan", "month", F.col("last_month_user_bin").alias("user_bin"))
        .agg(F.sum("num_comments").alias("num_comments"))
    )
    totals = settle_small(binned.groupBy("month").agg(F.sum("num_comments").alias("total")))
    # counts are summed, not shares, so the result does not depend on the order of addition
    overall = binned.groupBy("month", "partisan").agg(F.sum("num_comments").alias("num_comments"))
    both = binned.unionByName(overall.withColumn("user_bin", F.lit(0)))
    shared = both.join(totals, "month").withColumn("share", F.col("num_comments") / F.col("total"))
    return shared.select("month", "user_bin", "partisan", "share")


def extreme_shares(activity: DataFrame, scores: DataFrame, edges: tuple[float, float] = (-3.0, 3.0)) -> DataFrame:
    """Per month: shares of communities below, between and above the z edges."""
    stats = scores.agg(F.struct(F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"))).scalar()
    z = F.try_divide(F.col("score") - stats["mean"], stats["sd"])
    limits = F.array(*[F.lit(float(e)) for e in edges])
    labels = scores.select(F.col("id").alias("subreddit"), z.alias("z")).select(
        "subreddit", N.digitize(F.col("z"), limits).alias("label")
    ).where("label is not null")
    joined = activity.join(labels, "subreddit")
    sums = [
        F.sum(F.when(F.col("label") == i, F.col("num_comments")).otherwise(0)).alias(f"n{i}")
        for i in range(3)
    ]
    per_month = joined.groupBy("month").agg(*sums, F.sum("num_comments").alias("total"))
    shares = [(F.col(f"n{i}") / F.col("total")).alias(f"share_{i}") for i in range(3)]
    extreme = ((F.col("n0") + F.col("n2")) / F.col("total")).alias("total_extreme")
    return per_month.select("month", *shares, extreme)


def bin_shares(bin_sizes: DataFrame, dimen: str) -> DataFrame:
    """Share of comments in each of the five bins."""
    sizes = bin_sizes.where(F.col("dimen") == dimen).select("bin", "total_comments")
    total = sizes.where(F.col("bin").isin(BINS)).agg(F.sum("total_comments")).scalar()
    return for_list(sizes, "bin", BINS).withColumn("pct", F.col("total_comments") / total)


def echo_cells(cells: DataFrame, bin_sizes: DataFrame, dimen: str) -> DataFrame:
    """Five by five matrix in long form, missing cells 0, with the deviation from chance."""
    grid = cells.sparkSession.createDataFrame([(a, b) for a in BINS for b in BINS], "bin1 int, bin2 int")
    values = cells.where(F.col("dimen") == dimen).select("bin1", "bin2", F.col("bin1_avg_frac_bin2").alias("value"))
    shares = bin_shares(bin_sizes, dimen).select(F.col("bin").alias("bin2"), "pct")
    # 25 cells and 5 shares: small by construction once counted
    filled = grid.join(settle_small(values), ["bin1", "bin2"], "left").join(settle_small(shares), "bin2", "left")
    value = F.coalesce("value", F.lit(0.0))
    return filled.select("bin1", "bin2", value.alias("value"), "pct", (value - F.col("pct")).alias("deviation"))


def echo_matrix(cells: DataFrame) -> DataFrame:
    """Wide form of :func:`echo_cells`, one column per bin2."""
    wide = cells.groupBy("bin1").pivot("bin2", BINS).agg(F.max("value"))
    return wide.orderBy("bin1")


def max_deviation(cells: DataFrame) -> DataFrame:
    return cells.agg(F.max("deviation").alias("max_deviation"))


def echo_communities(community_cells: DataFrame, dimen: str, communities: int = 25, compat: bool = False) -> DataFrame:
    """Largest communities by bin shares, ordered by their average bin.

    Communities are ranked by their total and kept whole; a bin that a community lacks stays empty and
    counts 0 in the average. ``compat`` cuts after five rows per community, as published, which tears
    communities that have fewer bins.
    """
    cells = community_cells.where(F.col("dimen") == dimen)
    if compat:
        largest = cells.orderBy(F.desc("total_comments"), "subreddit", "bin2").limit(len(BINS) * communities)
    else:
        cells = settle(cells)
        totals = cells.groupBy("subreddit").agg(F.max("total_comments").alias("total"))
        largest = cells.join(totals.orderBy(F.desc("total"), "subreddit").limit(communities), "subreddit", "left_semi")
    wide = largest.groupBy("subreddit").pivot("bin2", BINS).agg(F.max("subreddit_avg_frac_bin2"))
    average = sum(F.coalesce(F.col(f"`{b}`"), F.lit(0.0)) * b for b in BINS)
    return wide.withColumn("avg_bin", average).orderBy(F.asc_nulls_last("avg_bin"), "subreddit")


def months_of(df: DataFrame, column: str, limit: int = MAX_MONTHS) -> list[str]:
    rows = collect_bounded(df.select(column).distinct(), limit, "months")
    return sorted(r[0] for r in rows if r[0] is not None)


def matrix(df: DataFrame, row: str, column: str, value: str, columns: list | None = None, fill: float | None = None) -> DataFrame:
    """Wide matrix; pass the column list to spare the scan that finds it."""
    columns = months_of(df, column) if columns is None else columns
    wide = df.groupBy(row).pivot(column, columns).agg(F.max(value)).orderBy(row)
    return wide if fill is None else wide.fillna(fill)


def lagged_pairs(pairs: DataFrame, lag: int = 12) -> DataFrame:
    """Month pairs whose positions among the distinct months differ by ``lag``; settles the pairs, read twice."""
    pairs = settle(pairs)
    months = pairs.select(F.col("m1").alias("m")).where("m is not null").distinct()
    # one row per month of the calendar
    placed = settle(months.withColumn("place", F.row_number().over(Window.orderBy("m"))))
    first = placed.select(F.col("m").alias("m1"), F.col("place").alias("__p1"))
    second = placed.select(F.col("m").alias("m2"), F.col("place").alias("__p2"))
    both = pairs.join(hint_small(first), "m1").join(hint_small(second), "m2")
    return both.where(F.col("__p2") - F.col("__p1") == lag).drop("__p1", "__p2")


def lag_statistics(pairs: DataFrame, lag: int = 12, before: str = "2016", value: str = "proportion_over") -> DataFrame:
    """Range of a lagged metric before a month, and the pair of its peak."""
    lagged = lagged_pairs(pairs, lag)
    early = F.col("m2") < before
    return lagged.agg(
        F.min(F.when(early, F.col(value))).alias("early_min"),
        F.max(F.when(early, F.col(value))).alias("early_max"),
        F.max(F.struct(F.col(value).alias("v"), "m1", "m2")).alias("peak"),
    ).select("early_min", "early_max", F.col("peak.m1").alias("peak_m1"), F.col("peak.m2").alias("peak_m2"), F.col("peak.v").alias("peak"))


def category_series(monthly: DataFrame, metric: str, after: str = "2012", before: str = "2019", hide: str | None = None) -> DataFrame:
    """Month by category matrix of a metric; one category may be blanked."""
    categories = ["all", "center", "left", "right"]
    wide = matrix(month_range(monthly, after, before), "month", "category", metric, categories)
    if hide:
        wide = wide.withColumn(hide, F.lit(None).cast("double"))
    return wide


def series_statistics(wide: DataFrame, before: str = "2016", column: str = "all") -> DataFrame:
    """Early range, peak month and value, and the lowest value after the peak."""
    peak = wide.agg(F.max_by(F.struct("month", F.col(column).alias("v")), F.struct(F.col(column), F.col("month")))).scalar()
    early = F.col("month") < before
    return wide.agg(
        F.min(F.when(early, F.col(column))).alias("early_min"),
        F.max(F.when(early, F.col(column))).alias("early_max"),
        F.min(F.when(F.col("month") > peak["month"], F.col(column))).alias("after_peak_min"),
    ).select("early_min", "early_max", "after_peak_min", peak["month"].alias("peak_month"), peak["v"].alias("peak"))


def cohort_matrix(cohorts: DataFrame, after: str = "2012", before: str = "2019", first_years: list[str] | None = None) -> DataFrame:
    return matrix(month_range(cohorts, after, before), "month", "first_year", "avg_abs_z_score", first_years)


def threshold_curves(ccdf: DataFrame) -> DataFrame:
    """Wide thresholds to ``m1, m2, threshold, value``."""
    columns = [c for c in ccdf.columns if c not in ("m1", "m2")]
    long = ccdf.unpivot(["m1", "m2"], [f"`{c}`" for c in columns], "threshold", "value")
    return long.withColumn("threshold", F.col("threshold").cast("double"))


def explained_polarization(explained: DataFrame, year: int | None = None) -> DataFrame:
    out = explained.select("year", "actual", "static_new", "static_old")
    return out if year is None else out.where(F.col("year") == year)
