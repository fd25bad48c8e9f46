"""Association tests between monthly features and breaks or residuals."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.functions.stats import pearson
from panelwright.functions.tdist import t_interval, t_quantile, two_sided_p


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "feature", value: str = "x") -> DataFrame:
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns]))
    return df.select(*keys, cells)


def exact_permutation(monthly: DataFrame, features: Sequence[str], events: Sequence[int], lags: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Exact p of the gap between event months and the rest, over all subsets of as many months.

    ``monthly`` has a position ``t`` and the features, one row per month; months without a value are
    left out. The C(n, k) subsets are counted, not written: the months are halved, sums of up to ``k``
    months of either half become rows, and each sum of the second half meets the sorted sums of the
    first, where its rank says with how many of them it passes the upper or the lower limit. So k = 5
    of 24 months takes 3,174 rows in place of 42,504. A feature with no more than ``k`` months is left out.
    """
    k = len(events)
    long = unpivot(monthly, ["t"], features).where("x IS NOT NULL")
    packed = long.groupBy("feature").agg(F.sort_array(F.collect_list(F.struct("t", "x"))).alias("p")).where(F.size("p") > k)
    n, x = F.size("p"), lambda c: c["x"]
    add = lambda cells: F.aggregate(F.transform(cells, x), F.lit(0.0), lambda acc, v: acc + v)
    totals = packed.select("feature", "p", n.alias("n"), add(F.col("p")).alias("all"))
    totals = totals.select("*", (F.lit(1.0) / k + F.lit(1.0) / (F.col("n") - k)).alias("c"), (F.col("all") / (F.col("n") - k)).alias("m"))
    at = lambda lag: lambda c: c["t"].isin([e - lag for e in events])
    tests = F.array(*[F.struct(F.lit(lag).alias("lag"), add(F.filter("p", at(lag))).alias("inside")) for lag in lags if min(events) - lag >= 0])
    limit = lambda t: F.abs(t["inside"] / k - (F.col("all") - t["inside"]) / (F.col("n") - k)) - 1e-12
    limits = F.transform(F.col("tests"), lambda t: F.struct(
        t["lag"].alias("lag"), t["inside"].alias("inside"), limit(t).alias("g"),
        ((F.col("m") + limit(t)) / F.col("c")).alias("high"), ((F.col("m") - limit(t)) / F.col("c")).alias("low")))
    tested = totals.withColumn("tests", tests).withColumn("tests", limits)
    cut = F.floor(F.col("n") / 2).cast("int")
    halves = F.array(F.struct(F.lit(0).alias("half"), F.slice("p", F.lit(1), cut).alias("q")), F.struct(F.lit(1).alias("half"), F.slice("p", cut + 1, F.col("n") - cut).alias("q")))
    sums = tested.select("feature", "n", "all", "tests", F.inline(halves))
    sums = sums.withColumn("_i", F.lit(-1)).withColumn("_s", F.lit(0.0)).withColumn("_k", F.lit(0))
    for _ in range(k):  # one more month, or an end: index ``size`` takes none and stays
        size = F.size("q")
        sums = sums.withColumn("_i", F.explode(F.sequence(F.least(F.col("_i") + 1, size), size)))
        sums = sums.withColumn("_s", F.col("_s") + F.coalesce(F.get("q", F.col("_i"))["x"], F.lit(0.0))).withColumn("_k", F.col("_k") + (F.col("_i") < size).cast("int"))
    # sums of the first half (kind 1) between the limits that the second half leaves: before equal sums (0) or after them (2)
    row = lambda size, kind, value, t=None: F.struct(
        size.alias("size"), F.lit(kind).alias("kind"), value.alias("value"), (t["lag"] if t is not None else F.lit(None).cast("int")).alias("lag"),
        (t["inside"] if t is not None else F.lit(None).cast("double")).alias("inside"), (t["g"] if t is not None else F.lit(None).cast("double")).alias("g"))
    asked = F.flatten(F.transform("tests", lambda t: F.array(row(k - F.col("_k"), 0, t["high"] - F.col("_s"), t), row(k - F.col("_k"), 2, t["low"] - F.col("_s"), t))))
    points = sums.select("feature", "n", "all", F.inline(F.when(F.col("half") == 0, F.array(row(F.col("_k"), 1, F.col("_s")))).otherwise(asked)))
    same = Window.partitionBy("feature", "size")
    is_sum = (F.col("kind") == 1).cast("long")
    ranked = points.withColumn("_below", F.sum(is_sum).over(same.orderBy("value", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ranked = ranked.withColumn("_of", F.sum(is_sum).over(same)).where("kind <> 1")
    upper = F.col("kind") == 0
    out = ranked.groupBy("feature", "lag").agg(
        F.first("n").alias("n_months"), F.first("inside").alias("_in"), F.first("all").alias("_all"), F.first("g").alias("_g"),
        F.sum(F.when(upper, F.col("_of"))).alias("n_subsets"), F.sum(F.when(upper, F.col("_of") - F.col("_below")).otherwise(F.col("_below"))).alias("_x"),
    )
    extreme = F.when(F.col("_g") <= 0, F.col("n_subsets")).otherwise(F.col("_x"))  # no gap: every subset has as large a one
    return out.select(
        "feature", "lag", "n_months", "n_subsets", (F.col("_in") / k).alias("inside"),
        ((F.col("_all") - F.col("_in")) / (F.col("n_months") - k)).alias("outside"), (extreme / F.col("n_subsets")).alias("p"),
    )


def within_month(rows: DataFrame, x: str, y: str, keys: Sequence[str] = ("feature", "lag")) -> DataFrame:
    """Both variables minus their month mean. Months are grouped, then joined: a month may be large."""
    used = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    means = used.groupBy(*keys, "month").agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    # means: one row per test and month
    return used.join(F.broadcast(means), [*keys, "month"]).withColumn("xd", F.col(x) - F.col("_mx")).withColumn("yd", F.col(y) - F.col("_my")).drop("_mx", "_my")


def within_month_effect(rows: DataFrame, x: str, y: str, n_permutations: int = 2000, seed: int = 20260920,
                        keys: Sequence[str] = ("feature", "lag")) -> DataFrame:
    """Slope inside months, and its p by shuffling the response inside every month.

    Rows are entity x month. A month's responses fold into one array (bounded by the number
    of regions), and each permutation orders it by a hash: nothing is self-joined.
    """
    demeaned = within_month(rows, x, y, keys)
    packed = demeaned.groupBy(*keys, "month").agg(F.sort_array(F.collect_list(F.struct("region", "xd", "yd"))).alias("p"))
    draws = packed.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n_permutations))))
    shuffled = F.transform(
        F.array_sort(F.transform("p", lambda c, i: F.struct(F.xxhash64(F.lit(seed), F.col("perm"), F.col("month"), i).alias("h"), c["yd"].alias("yd")))),
        lambda c: c["yd"],
    )
    response = F.when(F.col("perm") == 0, F.transform("p", lambda c: c["yd"])).otherwise(shuffled)
    dot = F.aggregate(F.zip_with(F.transform("p", lambda c: c["xd"]), response, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    square = F.aggregate("p", F.lit(0.0), lambda acc, c: acc + c["xd"] * c["xd"])
    sums = draws.select(*keys, "perm", dot.alias("_xy"), square.alias("_xx")).groupBy(*keys, "perm").agg(F.sum("_xy").alias("_xy"), F.sum("_xx").alias("_xx"))
    return _permutation_p(sums, keys, n_permutations)


def _permutation_p(sums: DataFrame, keys: Sequence[str], n_permutations: int) -> DataFrame:
    slope = F.col("_xy") / F.when(F.col("_xx") > 0, F.col("_xx"))
    slopes = sums.withColumn("_b", slope)
    seen = F.max(F.when(F.col("perm") == 0, F.col("_b"))).over(Window.partitionBy(*keys))
    tagged = slopes.withColumn("slope", seen).withColumn("_x", (F.col("perm") > 0) & (F.abs("_b") >= F.abs("slope")))
    out = tagged.groupBy(*keys).agg(F.first("slope").alias("slope"), F.count(F.when(F.col("_x"), 1)).alias("_k"))
    return out.where(F.col("slope").isNotNull()).select(*keys, "slope", ((F.col("_k") + 1) / (n_permutations + 1)).alias("p"))


def permutation_slope(pairs: DataFrame, x: str, y: str, n_permutations: int = 5000, seed: int = 20260921,
                      keys: Sequence[str] = ("feature", "step")) -> DataFrame:
    """Slope of a monthly regression and its p by shuffling the feature. One array per key (months)."""
    packed = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("month", F.col(x).alias("x"), F.col(y).alias("y")))).alias("p"),
        F.avg(x).alias("_mx"), F.avg(y).alias("_my"),
    )
    centred = packed.withColumn("xs", F.transform("p", lambda c: c["x"] - F.col("_mx"))).withColumn("ys", F.transform("p", lambda c: c["y"] - F.col("_my"))).drop("p")
    draws = centred.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n_permutations))))
    mixed = F.transform(
        F.array_sort(F.transform("xs", lambda v, i: F.struct(F.xxhash64(F.lit(seed), F.col("perm"), i).alias("h"), v.alias("v")))), lambda c: c["v"]
    )
    feature = F.when(F.col("perm") == 0, F.col("xs")).otherwise(mixed)
    dot = F.aggregate(F.zip_with(feature, F.col("ys"), lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    square = F.aggregate("xs", F.lit(0.0), lambda acc, v: acc + v * v)
    return _permutation_p(draws.select(*keys, "perm", dot.alias("_xy"), square.alias("_xx")), keys, n_permutations)


def regressions(pairs: DataFrame, x: str, y: str, keys: Sequence[str] = ("feature", "step")) -> DataFrame:
    """Slope and absolute t of every feature x step."""
    fits = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_sxx(y, x).alias("_xx"),
        F.regr_syy(y, x).alias("_yy"), F.regr_sxy(y, x).alias("_xy"),
    )
    residual = F.greatest(F.col("_yy") - F.col("_xy") * F.col("_xy") / F.col("_xx"), F.lit(0.0))
    se = F.sqrt(residual / F.greatest(F.col("n") - 2, F.lit(1)) / F.col("_xx"))
    return fits.where(F.col("_xx") > 0).select(*keys, "n", "slope", F.abs(F.col("slope") / F.when(se > 0, se)).alias("abs_t"))


def lagged(news: DataFrame, breaks: DataFrame, features: Sequence[str], lags: Sequence[int]) -> DataFrame:
    """News of month ``t`` beside breaks of month ``t + lag``: ``region, month, feature, lag, x, y``."""
    long = unpivot(news, ["region", "month"], features)
    spread = long.withColumn("lag", F.explode(F.array(*[F.lit(k) for k in lags]))).withColumn("month", F.add_months("month", F.col("lag")))
    target = breaks.select("region", "month", F.col("break_share").alias("y"))
    return target.join(spread, ["region", "month"])


def design_stats(rows: DataFrame, alpha: float, keys: Sequence[str] = ("feature", "lag"), x: str = "x", y: str = "y") -> DataFrame:
    """Pearson r, degrees of freedom, t, p and critical r: within months and pooled."""
    used = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    months = used.groupBy(*keys).agg(F.count_distinct("month").alias("n_months"))
    inner = within_month(used, x, y, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pearson("xd", "yd").alias("r"))
    inner = inner.join(months, list(keys)).select(F.lit("within_month").alias("design"), *keys, "n", (F.col("n") - F.col("n_months") - 1).alias("df"), "r")
    pooled = used.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pearson(x, y).alias("r")).select(
        F.lit("pooled").alias("design"), *keys, "n", (F.col("n") - 2).alias("df"), "r"
    )
    both = inner.unionByName(pooled)
    r = F.when(~F.isnan("r"), F.col("r"))
    usable = (F.col("df") > 0) & r.isNotNull() & (F.abs(r) < 1)
    t = F.when(usable, r * F.sqrt("df") / F.sqrt(1 - r * r))
    both = both.withColumn("r", r).withColumn("t", t)
    limit = F.when(F.col("t").isNotNull(), t_quantile(F.lit(1 - alpha / 2), F.col("df")))
    both = both.withColumn("p", two_sided_p(F.col("t"), F.col("df"))).withColumn("t_threshold", limit)
    return both.withColumn("r_critical", F.col("t_threshold") / F.sqrt(F.col("df") + F.col("t_threshold") * F.col("t_threshold")))


def corr_rows(rows: DataFrame, n_tests: int, alpha: float = 0.05) -> DataFrame:
    """All features, lags and designs; the Bonferroni verdict belongs to the within-month design only."""
    threshold = alpha / n_tests
    stats = design_stats(rows, threshold)
    passed = F.coalesce(F.col("p") < threshold, F.lit(False))
    return stats.withColumn("alpha", F.lit(threshold)).withColumn("passed", F.when(F.col("design") == "within_month", passed))


def bonferroni(tests: DataFrame, n_tests: int, alpha: float = 0.05, keys: Sequence[str] = ()) -> DataFrame:
    """Threshold, number passed and the best p with its row."""
    threshold = alpha / n_tests
    label = [c for c in ("feature", "lag", "step") if c in tests.columns]
    best = F.min(F.struct(F.round("p", 12).alias("p"), *label))
    out = (tests.groupBy(*keys) if keys else tests).agg(
        F.count(F.lit(1)).alias("n_tests"), F.count(F.when(F.col("p") < threshold, 1)).alias("n_passed"),
        F.count(F.when(F.col("p") < alpha, 1)).alias("n_nominal"), best.alias("b"),
    )
    return out.select(*keys, "n_tests", F.lit(threshold).alias("threshold"), "n_passed", "n_nominal", F.col("b.p").alias("best_p"), *[F.col(f"b.{c}").alias(f"best_{c}") for c in label])


def mean_intervals(rows: DataFrame, value: str, keys: Sequence[str], confidence: float = 0.95) -> DataFrame:
    """Mean with its t interval per key."""
    stats = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_s")
    )
    low, high = t_interval(F.col("mean"), F.col("_s"), F.col("n"), confidence)
    return stats.withColumn("ci_low", low).withColumn("ci_high", high).drop("_s")
