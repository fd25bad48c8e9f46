"""Bench of the detectors on injected disturbances.

Curves (series x injection) are rows with one array each; a curve is shipped once per
preparation mode and all detectors and penalties run on it. Scoring is joins and CASE.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.functions import arrays as A
from panelwright.functions.frames import null_safe
from panelwright.operators import detectors as D
from panelwright.protocol import BenchConfig

SETTING = ("detector", "mode", "penalty")
CURVE = ("kind", "magnitude", "position")


def noise(seed: int, ordinal: Column, position: Column, t: Column) -> Column:
    """Standard normal by Box-Muller from hashes: every detector sees the same draws."""
    def uniform(salt: int) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), ordinal, position, t, F.lit(salt)), 11)
        return (bits.cast("double") + 0.5) / float(2**53)

    return F.sqrt(-2.0 * F.log(uniform(1))) * F.cos(uniform(2) * 6.283185307179586)


def inject(y: Column, kind: str, magnitude: float, position: int, seed: int, ordinal: Column) -> Column:
    """A disturbance from ``position`` on, in units of the deviation of the monthly differences."""
    sigma = A.let(F.sqrt(A.variance_pop(A.diffs(y))), lambda s: F.when(s > 0, s).otherwise(F.lit(1.0)))

    def add(shift: Column) -> Column:
        if kind == "level":
            extra = lambda t: shift
        elif kind == "trend":
            extra = lambda t: shift * (t - position) / F.greatest(F.size(y) - position - 1, F.lit(1)) * 3.0
        elif kind == "variance":
            extra = lambda t: F.abs(shift) * noise(seed, ordinal, F.lit(position), t)
        else:
            raise ValueError(f"unknown kind of disturbance: {kind!r}")
        return F.transform(y, lambda v, t: F.when(t >= position, v + extra(t)).otherwise(v))

    return A.let(sigma * magnitude, add)


def curves(sample: DataFrame, config: BenchConfig, partitions: int | None = None) -> DataFrame:
    """The untouched twin and every injection of each sampled series (``series_id, ordinal, y``)."""
    entries = [("none", 0.0, None)] + [
        (kind, m, p) for p in config.positions for kind in config.kinds for m in config.magnitudes
    ]
    structs = [
        F.struct(
            F.lit(kind).alias("kind"), F.lit(float(m)).alias("magnitude"), F.lit(p).cast("int").alias("position"),
            (F.col("y") if kind == "none" else inject(F.col("y"), kind, m, p, config.seed, F.col("ordinal"))).alias("y"),
        )
        for kind, m, p in entries
    ]
    spread = sample.select("series_id", "ordinal", F.explode(F.array(*structs)).alias("c")).select("series_id", "ordinal", "c.*")
    if partitions is not None:
        # the detectors are heavy per row and the rows are few: spread them by series
        spread = spread.repartition(partitions, "series_id")
    return spread


def settings(config: BenchConfig, kernel_penalties: dict[tuple[str, float], float] | None = None) -> list[tuple[str, float | None]]:
    """Detector and nominal penalty of every run; CUSUM has its own threshold and runs once."""
    out: list[tuple[str, float | None]] = []
    for detector in config.detectors:
        if detector == "cusum":
            out.append((detector, None))
            continue
        if detector == "kernel_rbf" and kernel_penalties is None:
            raise ValueError("the kernel penalty is not comparable without calibration: pass kernel_penalties")
        out += [(detector, p) for p in config.penalties]
    return out


def effective_penalty(detector: str, mode: str, penalty: float | None, kernel_penalties: dict[tuple[str, float], float] | None) -> float | None:
    if detector == "cusum":
        return None
    if detector != "kernel_rbf":
        return penalty
    if kernel_penalties is None:
        raise ValueError("the kernel penalty is not comparable without calibration: pass kernel_penalties")
    return kernel_penalties[mode, penalty]


def prepared(rows: DataFrame, modes: Sequence[str]) -> DataFrame:
    """``z`` of every mode with its month offset."""
    each = [
        F.struct(F.lit(m).alias("mode"), F.lit(D.OFFSET[m]).alias("offset"), D.prepare(F.col("y"), m).alias("z")) for m in modes
    ]
    return rows.select("*", F.explode(F.array(*each)).alias("m")).select("*", "m.*").drop("m")


def flag_sets(
    rows: DataFrame, detectors: Sequence[str], penalties: Sequence[float],
    kernel_grid: dict[str, Sequence[float]] | None = None, first_only: bool | Column = False,
) -> DataFrame:
    """``months`` flagged per detector and penalty for rows with ``z, offset, mode``.

    ``kernel_grid`` gives the raw kernel penalties per mode, in the order of ``penalties``. ``first_only``: rows
    of which only the first month is asked (the segmentation detectors stop there).
    """
    n_windows = F.greatest(F.size("z") + F.col("offset") - D.MIN_HISTORY, F.lit(0))
    work, runs = rows, []

    def entry(detector: str, penalty: float | None, effective: Column, months: Column) -> Column:
        return F.struct(
            F.lit(detector).alias("detector"), F.lit(penalty).cast("double").alias("penalty"), effective.cast("double").alias("penalty_effective"),
            F.coalesce(months, F.array().cast("array<int>")).alias("months"),
            F.when(months.isNull(), n_windows).otherwise(F.lit(0)).alias("n_failed"),
        )

    for detector in detectors:
        if detector == "cusum":
            work = work.withColumn("_cusum", D.cusum_flags(F.col("z"), F.col("offset")))
            runs.append(entry("cusum", None, F.lit(None), F.col("_cusum")))
        elif detector == "kernel_rbf":
            if kernel_grid is None:
                raise ValueError("the kernel penalty is not comparable without calibration: pass kernel_grid")
            grid = sorted({p for ps in kernel_grid.values() for p in ps})
            work = work.withColumn("_kernel", D.flag_column(F.col("z"), F.col("offset"), detector, grid, first_only))
            for i, p in enumerate(penalties):
                eff = F.lit(None).cast("double")
                at = F.lit(None).cast("int")
                for mode, raw in kernel_grid.items():
                    eff = F.when(F.col("mode") == mode, F.lit(float(raw[i]))).otherwise(eff)
                    at = F.when(F.col("mode") == mode, F.lit(grid.index(raw[i]))).otherwise(at)
                runs.append(entry(detector, p, eff, F.get("_kernel", at)))
        else:
            work = work.withColumn(f"_{detector}", D.flag_column(F.col("z"), F.col("offset"), detector, penalties, first_only))
            runs += [entry(detector, p, F.lit(p), F.col(f"_{detector}")[i]) for i, p in enumerate(penalties)]
    kept = [c for c in rows.columns if c not in ("y", "z", "offset")]
    return work.select(*kept, F.inline(F.array(*runs)))


def calibrate_kernel(
    clean: DataFrame, penalties: Sequence[float], grid: Sequence[float], reference: str = "pelt"
) -> DataFrame:
    """Per mode and penalty the grid value whose number of alarmed series is nearest the reference's.

    ``clean`` has ``mode, z, offset`` of untouched series. Ties go to the smallest value.
    """
    if not grid:
        raise ValueError("the calibration grid is empty")

    def alarms(detector: str, pens: Sequence[float], name: str) -> DataFrame:
        found = clean.select("mode", D.flag_column(F.col("z"), F.col("offset"), detector, pens, first_only=True).alias("f"))
        fallback = F.array_repeat(F.array().cast("array<int>"), len(pens))
        each = found.select("mode", F.col("f").isNull().alias("bad"), F.posexplode(F.coalesce("f", fallback)).alias("i", "m"))
        values = F.array(*[F.lit(float(p)) for p in pens])
        return each.groupBy("mode", "i").agg(
            F.count(F.when(F.size("m") > 0, 1)).alias(f"n_{name}"), F.count(F.when(F.col("bad"), 1)).alias(f"failed_{name}"),
            F.count(F.lit(1)).alias("n_series"),
        ).withColumn(name, F.get(values, F.col("i"))).drop("i")

    kernel = alarms("kernel_rbf", grid, "kernel_pen").drop("n_series")
    base = alarms(reference, penalties, "penalty")
    pairs = base.join(F.broadcast(kernel), "mode")  # penalties x grid rows per mode
    nearest = F.min(F.struct(F.abs(F.col("n_kernel_pen") - F.col("n_penalty")).alias("gap"), "kernel_pen", "n_kernel_pen", "failed_kernel_pen"))
    return pairs.groupBy("mode", "penalty").agg(
        nearest.alias("b"), F.max("n_penalty").alias("_n"), F.max("n_series").alias("_all"), F.max("failed_penalty").alias("n_failed_reference"),
        F.sum("failed_kernel_pen").alias("n_failed_grid"),
    ).select(
        "mode", "penalty", F.col("b.kernel_pen").alias("kernel_pen"), (F.col("_n") / F.col("_all") * 100).alias("alarms_reference_pct"),
        (F.col("b.n_kernel_pen") / F.col("_all") * 100).alias("alarms_kernel_pct"), "n_failed_reference",
        F.col("b.failed_kernel_pen").alias("n_failed_kernel"), "n_failed_grid",
    )


def score(flagged: DataFrame, max_delay: int | None, twin_rule: bool) -> DataFrame:
    """Bench rows: clean alarms, detections, late and twin-vetoed signals. One pass: a curve meets its untouched twin in a window."""
    twins = Window.partitionBy("series_id", *SETTING)
    spoiled = F.col("kind") != "none"
    rows = flagged.withColumn("signal", F.get("months", F.lit(0))).withColumn("twin", F.max(F.when(~spoiled, F.col("months"))).over(twins))
    heard = F.col("signal").isNotNull()
    after = spoiled & heard & (F.col("signal") >= F.col("position"))
    late = after & (F.col("signal") - F.col("position") > max_delay) if max_delay is not None else F.lit(False)
    twin = spoiled & heard & F.coalesce(F.array_contains("twin", F.col("signal")), F.lit(False))
    rows = rows.withColumn("late", F.coalesce(late, F.lit(False))).withColumn("twin_flag_at_signal", twin)
    veto = F.col("twin_flag_at_signal") if twin_rule else F.lit(False)
    hit = F.coalesce(after, F.lit(False)) & ~F.col("late") & ~veto
    early = F.when(spoiled, heard & (F.col("signal") < F.col("position"))).otherwise(heard)
    return rows.select(
        *SETTING, "penalty_effective", *CURVE, "series_id", hit.alias("detected"), F.when(hit, F.col("signal") - F.col("position")).alias("delay"),
        F.coalesce(early, F.lit(False)).alias("false_alarm"), "signal", "n_failed", "twin_flag_at_signal", "late",
    )


def run_bench(
    sample: DataFrame, config: BenchConfig, kernel_grid: dict[str, Sequence[float]] | None = None, partitions: int | None = None
) -> DataFrame:
    """Bench rows of every curve and setting.

    With ``partitions`` the curves of a series stay together, so the flags meet their twins where they were made.
    """
    rows = prepared(curves(sample, config, partitions), config.modes)
    # of a disturbed curve the score reads the first signal only, of an untouched one all months
    flagged = flag_sets(rows, config.detectors, config.penalties, kernel_grid, F.col("kind") != "none").drop("ordinal")
    return score(flagged, config.max_delay, config.twin_rule)


def summarise(bench: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Detection, delay and clean alarms per setting; the empty penalty of CUSUM is a key too. The bench is read once."""
    key = [*SETTING, *by]
    spoiled, hit = F.col("kind") != "none", F.col("detected")
    after = F.col("signal").isNotNull() & (F.col("signal") >= F.col("position"))
    delays = F.when(hit, F.col("delay"))
    zero = F.lit(0).cast("bigint")
    # a delay is at most max_delay or the series length, so the median state stays small
    found = bench.groupBy(*key).agg(
        (F.avg(F.when(spoiled, hit.cast("double"))) * 100).alias("detected_pct"),
        F.median(delays).alias("delay_median"),
        F.avg(delays).alias("delay_mean"),
        (F.avg(F.when(hit, (F.col("delay") == 0).cast("double"))) * 100).alias("zero_delay_pct"),
        F.count(F.when(spoiled, 1)).alias("n_spoiled"),
        F.count(F.when(spoiled & F.col("late"), 1)).alias("n_late"),
        F.count(F.when(spoiled & after & ~F.col("late") & ~hit, 1)).alias("n_twin_vetoed"),
        F.sum(F.when(spoiled, F.col("n_failed"))).alias("_fs"),
        F.sum(F.when(~spoiled, F.col("n_failed"))).alias("_fc"),
        F.count(F.when(~spoiled, 1)).alias("_clean"),
        F.count(F.when(~spoiled & F.col("false_alarm"), 1)).alias("_alarms"),
    )
    # untouched curves belong to every group of their setting; here are a few rows per setting
    setting = Window.partitionBy(*SETTING)
    n_clean = F.sum("_clean").over(setting)
    out = found.withColumns({
        "clean_alarms_pct": F.when(n_clean > 0, F.sum("_alarms").over(setting) / n_clean * 100), "n_clean": n_clean, "_fc": F.coalesce(F.sum("_fc").over(setting), zero)})
    out = out.where("n_spoiled > 0").withColumn("youden_j", F.col("detected_pct") - F.col("clean_alarms_pct"))
    return out.withColumn("n_failed", F.col("_fs") + F.col("_fc")).drop("_fs", "_fc", "_clean", "_alarms")


def select_penalty(summary: DataFrame) -> DataFrame:
    """Per detector and mode: the largest J rounded to 9 digits, the smallest penalty on ties."""
    best = F.max(F.struct(F.round("youden_j", 9).alias("j"), (-F.col("penalty")).alias("p")))
    return summary.groupBy("detector", "mode").agg(best.alias("b")).select(
        "detector", "mode", (-F.col("b.p")).alias("penalty"), F.col("b.j").alias("youden_j")
    )


def warnings(bench: DataFrame, chosen: DataFrame, calibration: DataFrame | None, penalties: Sequence[float], grid: Sequence[float] = ()) -> DataFrame:
    """Rows worth a look: choices on a grid edge, failed steps, injections in December or January."""
    edges = [float(min(penalties)), float(max(penalties))]
    on_edge = chosen.where(F.col("penalty").isin(*edges)).select(
        F.lit("penalty on the grid edge").alias("warning"), F.concat_ws("/", "detector", "mode").alias("where"), F.lit(1).cast("bigint").alias("n")
    )
    failed = bench.where(F.col("n_failed") > 0).groupBy("detector", "mode").agg(F.sum("n_failed").alias("n")).select(
        F.lit("failed steps").alias("warning"), F.concat_ws("/", "detector", "mode").alias("where"), "n"
    )
    turn = bench.where((F.col("kind") != "none") & (F.col("position") % 12).isin(11, 0)).groupBy("position").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("injection in December or January").alias("warning"), F.col("position").cast("string").alias("where"), "n"
    )
    out = on_edge.unionByName(failed).unionByName(turn)
    if calibration is not None and len(grid):
        at_edge = calibration.where(F.col("kernel_pen").isin(float(min(grid)), float(max(grid)))).select(
            F.lit("calibration on the grid edge").alias("warning"), F.concat_ws("/", "mode", F.col("penalty").cast("string")).alias("where"),
            F.lit(1).cast("bigint").alias("n"))
        out = out.unionByName(at_edge)
    return out


def december_cut(bench: DataFrame) -> DataFrame:
    """Share of detections signalled in December, and detection without them."""
    rows = bench.where(F.col("kind") != "none")
    december = F.col("detected") & (F.col("signal") % 12 == 11)
    return rows.groupBy(*SETTING).agg(
        F.count(F.when(F.col("detected"), 1)).alias("n_detected"),
        F.count(F.when(december, 1)).alias("n_december"),
        (F.count(F.when(december, 1)) / F.nullif(F.count(F.when(F.col("detected"), 1)), F.lit(0)) * 100).alias("december_pct"),
        (F.avg((F.col("detected") & ~december).cast("double")) * 100).alias("detected_without_pct"),
    )


def december_groups(bench: DataFrame) -> DataFrame:
    """Detections by signal month, injection position and delay."""
    rows = bench.where(F.col("detected"))
    return rows.groupBy((F.col("signal") % 12 + 1).alias("month_no"), "position", "delay").agg(F.count(F.lit(1)).alias("n"))


def without_december(bench: DataFrame) -> DataFrame:
    """The bench with December detections struck out, for deriving J and the penalty again."""
    december = F.col("detected") & (F.col("signal") % 12 == 11)
    return bench.withColumn("delay", F.when(~december, F.col("delay"))).withColumn("detected", F.col("detected") & ~december)


def kind_by_position(bench: DataFrame, positions: Sequence[int]) -> DataFrame:
    """Detection percent, positions as columns, with the share of alarms before the injection."""
    rows = bench.where(F.col("kind") != "none")
    cells = []
    for p in positions:
        here = F.col("position") == p
        cells.append((F.avg(F.when(here, F.col("detected").cast("double"))) * 100).alias(f"detected_{p}"))
        cells.append((F.avg(F.when(here, F.col("false_alarm").cast("double"))) * 100).alias(f"early_{p}"))
    return rows.groupBy(*SETTING, "kind").agg(*cells)


def first_alarm_mode(bench: DataFrame) -> DataFrame:
    """Most frequent month of the first false alarm on clean series per setting, ties kept."""
    rows = bench.where((F.col("kind") == "none") & F.col("signal").isNotNull())
    counts = rows.groupBy(*SETTING, "signal").agg(F.count(F.lit(1)).alias("n"))
    top = F.rank().over(Window.partitionBy(*SETTING).orderBy(F.desc("n")))
    return counts.withColumn("_r", top).where(F.col("_r") == 1).drop("_r")


def transform_test(summary: DataFrame, better: str = "ratio", worse: str = "raw") -> DataFrame:
    """Per detector and penalty: does one preparation beat the other on J and on clean alarms?"""
    def side(mode: str, tag: str) -> DataFrame:
        return summary.where(F.col("mode") == mode).select(
            "detector", "penalty", F.col("youden_j").alias(f"j_{tag}"), F.col("clean_alarms_pct").alias(f"alarms_{tag}"))

    both = null_safe(side(better, "a"), side(worse, "b"), ["detector", "penalty"], how="inner")
    return both.withColumn("gain", F.col("j_a") - F.col("j_b")).withColumn(
        "wins", (F.col("j_a") > F.col("j_b")) & (F.col("alarms_a") < F.col("alarms_b"))
    )


def transform_verdict(test: DataFrame) -> DataFrame:
    """Every method wins, and the spread of J among methods is below the smallest gain."""
    return test.agg(
        F.count(F.lit(1)).alias("n_methods"), F.count(F.when(F.col("wins"), 1)).alias("n_wins"),
        (F.max("j_a") - F.min("j_a")).alias("spread"), F.min("gain").alias("smallest_gain"),
    ).withColumn("transform_matters_more", (F.col("n_wins") == F.col("n_methods")) & (F.col("spread") < F.col("smallest_gain")))
