"""Statistics of long scores ``id, dim, score`` and of clusters of scored items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sharelens.functions import numeric as N
from sharelens.functions.text import redact
from sharelens.operators.positions import exact_quantile, with_position
from sharelens.session import settle, settle_small

# Words for the low and the high end of a dimension.
LESS_MORE = {
    "gender": ("masculine", "feminine"),
    "age": ("young", "old"),
    "partisan": ("left wing", "right wing"),
    "affluence": ("poor", "affluent"),
    "time": ("older", "newer"),
    "sociality": ("less social", "more social"),
    "edginess": ("kinder", "edgier"),
}
# Published cutoffs of the neutral dimension.
NEUTRAL_CUTOFFS = {"partisan_b": 0.49748743718592964, "partisan": 0.5125628140703518}


def moments(scores: DataFrame) -> DataFrame:
    """Per dimension: n, mean, population sigma, lowest, highest."""
    return scores.groupBy("dim").agg(
        F.count("score").alias("n"),
        F.avg("score").alias("mean"),
        F.stddev_pop("score").alias("sd"),
        F.min("score").alias("low"),
        F.max("score").alias("high"),
    )


def _with_moments(scores: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Rows with their dimension's moments as struct ``m``.

    The moments of all dimensions are joined, by broadcast if they are few. Without ``of`` the scores are
    settled first, because moments and rows both read them; pass ``of=scores`` if they are stored already.
    """
    if of is None:
        scores = of = settle(scores)
    table = moments(of).select(F.col("dim").alias("__dim"), F.struct("n", "mean", "sd", "low", "high").alias("m"))
    return scores.join(settle_small(table), F.col("dim").eqNullSafe(F.col("__dim")), "left").drop("__dim")


def _z(value: Column = None) -> Column:
    value = F.col("score") if value is None else value
    return F.try_divide(value - F.col("m.mean"), F.col("m.sd"))


def z_scores(scores: DataFrame) -> DataFrame:
    """``id, dim, score, z`` with population sigma per dimension."""
    return _with_moments(scores).withColumn("z", _z()).drop("m")


def z_bins(scores: DataFrame, bound: int = 3) -> DataFrame:
    """z cut toward zero and clamped, with its absolute value."""
    z = z_scores(scores)
    return z.withColumn("z_bin", N.truncate_clamp(F.col("z"), bound)).withColumn(
        "abs_z", F.abs("z")
    )


def percentiles(scores: DataFrame) -> DataFrame:
    """Ordinal percentile ``100 * rank0 / n`` per dimension, ties by id."""
    placed = with_position(scores, ["score", "id"], ["dim"], "rank0")
    placed = settle(placed)
    sizes = settle_small(placed.groupBy(F.col("dim").alias("__dim")).agg(F.count(F.lit(1)).alias("__n")))
    joined = placed.join(sizes, F.col("dim").eqNullSafe(F.col("__dim")))
    return joined.withColumn("pctl", F.lit(100.0) * F.col("rank0") / F.col("__n")).drop("__dim", "__n")


def histogram(scores: DataFrame, bins: int = 100) -> DataFrame:
    """``dim, bin, bin_left, count`` over equal bins from lowest to highest score."""
    low, high = F.col("m.low"), F.col("m.high")
    binned = _with_moments(scores).select(
        "dim",
        N.equal_width_bin(F.col("score"), low, high, bins).alias("bin"),
        N.bin_left(low, high).alias("first"),
        N.bin_width(low, high, bins).alias("width"),
    )
    counted = binned.groupBy("dim", "bin", "first", "width").agg(F.count(F.lit(1)).alias("count"))
    return counted.select(
        "dim", "bin", (F.col("first") + F.col("bin") * F.col("width")).alias("bin_left"), "count"
    )


def clustered(scores: DataFrame, clustering: DataFrame) -> DataFrame:
    """Scores of clustered items: ``id, dim, ..., cluster_id, cluster_name``."""
    return scores.join(clustering.select("id", "cluster_id", "cluster_name"), "id")


def densities(members: DataFrame, edges: int = 40) -> DataFrame:
    """Density histogram per cluster on bins shared by all clusters of a dimension.

    ``edges`` edges make ``edges - 1`` bins; empty bins are kept with density 0.
    """
    bins = edges - 1
    low, high = F.col("m.low"), F.col("m.high")
    binned = _with_moments(members).select(
        "dim",
        "cluster_id",
        N.equal_width_bin(F.col("score"), low, high, bins).alias("bin"),
        N.bin_left(low, high).alias("first"),
        N.bin_width(low, high, bins).alias("width"),
    )
    counted = binned.groupBy("dim", "cluster_id", "first", "width", "bin").agg(
        F.count(F.lit(1)).alias("count")
    )
    # after counting there are at most `bins` rows per cluster and dimension
    per_cluster = counted.groupBy("dim", "cluster_id", "first", "width").agg(
        F.sum("count").alias("n"),
        F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("counts"),
    )
    rows = per_cluster.select(
        "dim", "cluster_id", "n", "first", "width", "counts",
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"),
    )
    count = F.coalesce(F.try_element_at("counts", F.col("bin")), F.lit(0))
    return rows.select(
        "dim",
        "cluster_id",
        "bin",
        (F.col("first") + (F.col("bin") + 0.5) * F.col("width")).alias("midpoint"),
        count.alias("count"),
        (count / (F.col("n") * F.col("width"))).alias("density"),
    )


def cluster_moments(members: DataFrame, scores: DataFrame) -> DataFrame:
    """Per cluster and dimension: mean as z of all scores, sample variance, count."""
    per = members.groupBy("dim", "cluster_name").agg(
        F.avg("score").alias("mean"),
        F.var_samp("score").alias("variance"),
        F.count("score").alias("count"),
    )
    return (
        _with_moments(per.withColumn("score", F.col("mean")), scores)
        .select("dim", "cluster_name", _z().alias("mean_z"), "variance", "count")
    )


def cluster_extremes(members: DataFrame) -> DataFrame:
    """Lowest and highest member of each cluster, ties by id."""
    lowest = F.min(F.struct("score", "id"))
    highest = F.max(F.struct("score", "id"))
    return members.groupBy("dim", "cluster_id").agg(lowest.alias("lo"), highest.alias("hi")).select(
        "dim", "cluster_id",
        F.col("lo.id").alias("minimum_id"), F.col("lo.score").alias("minimum"),
        F.col("hi.id").alias("maximum_id"), F.col("hi.score").alias("maximum"),
    )


def outliers(scores: DataFrame, sigmas: float = 2.0) -> DataFrame:
    """Scores at least ``sigmas`` population sigmas from their mean."""
    far = F.abs(F.col("score") - F.col("m.mean")) >= F.lit(sigmas) * F.col("m.sd")
    return _with_moments(scores).where(far).drop("m")


def cluster_means(members: DataFrame) -> DataFrame:
    """Mean score per cluster and dimension."""
    return members.groupBy("cluster_name", "dim").agg(F.avg("score").alias("mean_score"))


def dimension_correlation(wide: DataFrame, a: str, b: str) -> DataFrame:
    return wide.agg(N.pearson(a, b).alias("pearson_r"))


def _words(dim: Column, which: int) -> Column:
    pairs = [F.lit(x) for name, words in LESS_MORE.items() for x in (name, words[which])]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.split_part(dim, F.lit("_"), F.lit(1))), F.lit(""))


def skews(
    scores: DataFrame,
    clustering: DataFrame,
    threshold: int = 20,
    pairs: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """Direction and strength of each cluster's skew on each dimension.

    One grouping serves all clusters and dimensions: mean z, and the share of
    members beyond the percentile threshold on the side of the mean.
    """
    ranked = settle(percentiles(scores))
    per = _with_moments(clustered(ranked, clustering), ranked).groupBy(F.col("cluster_name").alias("cluster"), F.col("dim").alias("axis")).agg(
        F.avg(_z()).alias("mean_z"),
        (F.avg((F.col("pctl") < threshold).cast("double")) * 100.0).alias("below"),
        (F.avg((F.col("pctl") > 100 - threshold).cast("double")) * 100.0).alias("above"),
    )
    left = F.col("mean_z") < 0
    out = per.select(
        "cluster", "axis",
        F.when(left, _words(F.col("axis"), 0)).otherwise(_words(F.col("axis"), 1)).alias("word"),
        F.when(left, F.col("below")).otherwise(F.col("above")).alias("frac"),
        F.when(left, threshold).otherwise(100 - threshold).alias("pctl"),
        F.when(left, "below").otherwise("above").alias("side"),
        "mean_z",
    )
    share = F.bround("frac", 0).cast("int").cast("string")
    desc = F.concat(
        "cluster", F.lit(" communities skew "), "word", F.lit(" ("), share, F.lit("% are "), "side",
        F.lit(" the "), F.col("pctl").cast("string"), F.lit("th percentile)"),
    )
    out = out.withColumn("desc", desc).drop("side")
    if pairs is not None:
        wanted = F.lit(False)
        for cluster, axis in pairs:
            wanted = wanted | ((F.col("cluster") == cluster) & (F.col("axis") == axis))
        return out.where(wanted)
    return out.orderBy(F.desc("frac"), "cluster", "axis")


def bimodality(percentile_members: DataFrame, window: int = 20) -> DataFrame:
    """Share of a cluster's members outside the middle percentiles."""
    outside = (F.col("pctl") < window) | (F.col("pctl") > 100 - window)
    return percentile_members.groupBy("cluster_name", "dim").agg(
        (F.avg(outside.cast("double")) * 100.0).alias("frac")
    )


def neutral_cutoff(wide: DataFrame, dimension: str, cutoffs: dict[str, float] | None = None) -> float | None:
    """The published cutoff of a dimension's neutral score, else its 90th percentile."""
    cutoffs = NEUTRAL_CUTOFFS if cutoffs is None else cutoffs
    if dimension in cutoffs:
        return cutoffs[dimension]
    return exact_quantile(wide, dimension + "_neutral", 0.9).first()["quantile"]


def politics_subset(
    wide: DataFrame,
    dimension: str,
    category: str = "all",
    absolute: bool = False,
    cutoffs: dict[str, float] | None = None,
    view: str | None = None,
    cutoff: Column | float | None = None,
) -> DataFrame:
    """``id, partisan_dimen``: z of a dimension for politically active items.

    Items need a neutral score above the cutoff (the 90th percentile when none
    is published); categories cut the z at -1 and 1. Callers that want several categories compute
    :func:`neutral_cutoff` once and pass it.
    """
    if category not in ("left", "right", "all", "center", "all_unfiltered"):
        raise ValueError(category)
    neutral = dimension + "_neutral"
    stats = wide.agg(
        F.struct(F.avg(dimension).alias("mean"), F.stddev_pop(dimension).alias("sd"))
    ).scalar()
    z = F.try_divide(F.col(dimension) - stats["mean"], stats["sd"])
    kept = wide
    if category != "all_unfiltered":
        kept = kept.where(F.col(neutral) > (neutral_cutoff(wide, dimension, cutoffs) if cutoff is None else cutoff))
    out = kept.select("id", z.alias("partisan_dimen"))
    if category == "left":
        out = out.where("partisan_dimen <= -1")
    elif category == "right":
        out = out.where("partisan_dimen >= 1")
    elif category == "center":
        out = out.where("partisan_dimen < 1 and partisan_dimen > -1")
    if absolute:
        out = out.withColumn("partisan_dimen", F.abs("partisan_dimen"))
    if view:
        out.createOrReplaceTempView(view)
    return out


def exemplars(scores: DataFrame, count: int = 20) -> DataFrame:
    """For evenly spaced thresholds, the item with the lowest score at or above each.

    An item is a candidate only for the highest threshold it reaches; the best
    of each step then serves all lower thresholds, so no threshold meets all rows.
    """
    edges = N.even_edges(F.col("m.low"), F.col("m.high"), count)
    steps = (
        _with_moments(scores)
        .withColumn("edges", edges)
        .select("dim", "score", "id", "edges", (N.digitize(F.col("score"), F.col("edges")) - 1).alias("step"))
        .groupBy("dim", "step", "edges")
        .agg(F.min(F.struct("score", "id")).alias("best"))
    )
    # at most `count` rows per dimension from here on
    per_dim = steps.groupBy("dim", "edges").agg(F.collect_list(F.struct("step", "best")).alias("found"))
    rows = per_dim.select("dim", "found", F.posexplode("edges").alias("step", "threshold"))
    reached = F.filter("found", lambda f: f["step"] >= F.col("step"))
    best = F.array_min(F.transform(reached, lambda f: f["best"]))
    return rows.select("dim", "step", "threshold", best.alias("best")).select(
        "dim", "step", "threshold", F.col("best.id").alias("id"), F.col("best.score").alias("score")
    )


def top_bottom(scores: DataFrame, n: int = 50) -> DataFrame:
    """The n lowest and n highest items per dimension: ``dim, side, rank, id, score``; settles the scores, both sides read them."""
    scores, parts = settle(scores), []
    for side, order in (("lowest", F.asc("score")), ("highest", F.desc("score"))):
        window = Window.partitionBy("dim").orderBy(order, "id")
        parts.append(
            scores.withColumn("rank", F.row_number().over(window))
            .where(F.col("rank") <= n)
            .select("dim", F.lit(side).alias("side"), "rank", "id", "score")
        )
    return parts[0].unionByName(parts[1])


def extremes_table(
    scores: DataFrame,
    words: DataFrame,
    dimension: str,
    n: int = 8,
    ban_words: DataFrame | None = None,
) -> DataFrame:
    """Extreme communities and words of a dimension: ``item, type, score`` (z).

    ``words`` has one column per dimension; a missing column falls back to
    ``age``, and the z of words uses the scores of that dimension.
    """
    word_dim = dimension if dimension in words.columns else "age"
    scores = settle(scores)
    if ban_words is not None:
        words = words.join(settle_small(ban_words.select("word")), "word", "left_anti")
    long_words = words.select(F.col("word").alias("id"), F.lit(word_dim).alias("dim"), F.col(word_dim).alias("score"))
    communities = top_bottom(scores.where(F.col("dim") == dimension), n)
    found = top_bottom(long_words, n)
    communities = _with_moments(communities, scores).select(
        F.col("id").alias("item"), F.lit("community").alias("type"), _z().alias("score")
    )
    found = _with_moments(found, scores).select(
        redact(F.col("id")).alias("item"), F.lit("word").alias("type"), _z().alias("score")
    )
    return communities.unionByName(found)


def marked_items(scores: DataFrame, names: DataFrame) -> DataFrame:
    """z scores of named items, in order."""
    z = z_scores(scores).join(settle_small(names.select("id")), "id", "left_semi")
    return z.orderBy("dim", "z", "id")


def score_summary(scores: DataFrame) -> DataFrame:
    """Range and mean of each dimension."""
    return scores.groupBy("dim").agg(
        F.min("score").alias("lowest"), F.max("score").alias("highest"), F.avg("score").alias("mean")
    )


def export_scores(scores: DataFrame, clustering: DataFrame, names: list[str]) -> DataFrame:
    """Clustering with ``<dim>_pctl`` and ``<dim>_raw`` columns."""
    ranked = percentiles(scores)
    values = [F.max("pctl").alias("pctl"), F.max("score").alias("raw")]
    wide = ranked.groupBy("id").pivot("dim", names).agg(*values)
    out = clustering.select("id", "cluster_name").join(wide, "id", "left")
    return out.withColumnsRenamed(
        {f"edginess_{kind}": f"edgy_{kind}" for kind in ("pctl", "raw")}
    )
