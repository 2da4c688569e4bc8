"""Ordered-sequence operators: everything that looks at neighbouring frames of one sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def of(seq: str = "seq", order: str = "ord"):
    return Window.partitionBy(seq).orderBy(order)


def upto(seq: str = "seq", order: str = "ord"):
    return of(seq, order).rowsBetween(Window.unboundedPreceding, 0)


def step_length(columns: list[str], w) -> Column:
    """Distance to the previous frame; null for the first."""
    total = F.lit(0.0)
    for c in columns:
        d = F.col(c) - F.lag(c).over(w)
        total = total + d * d
    return F.sqrt(total)


def unwrapped(df: DataFrame, angle: str, out: str, seq: str = "seq", order: str = "ord") -> DataFrame:
    """Degrees with multiples of 360 added, so that no step is larger than 180; a step of 180 keeps its sign."""
    d = F.col(angle) - F.lag(angle).over(of(seq, order))
    m = F.pmod(d + 180, F.lit(360.0)) - 180
    m = F.when((m == -180) & (d > 0), 180.0).otherwise(m)
    fix = F.when(F.abs(d) < 180, 0.0).otherwise(m - d)
    with_fix = df.withColumn("_fix", F.coalesce(fix, F.lit(0.0)))
    return with_fix.withColumn(out, F.col(angle) + F.sum("_fix").over(upto(seq, order))).drop("_fix")


def smoothed(value: str, half: int, seq: str = "seq", order: str = "ord") -> Column:
    """Centred mean of 2 * half + 1 frames; beyond the ends, the first and last value count again."""
    w, whole = of(seq, order), Window.partitionBy(seq)
    n = F.count("*").over(whole)
    place = F.row_number().over(w)
    before, after = F.greatest(F.lit(0), half + 1 - place), F.greatest(F.lit(0), half - (n - place))
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inner = F.sum(value).over(w.rowsBetween(-half, half))
    return (inner + before * F.first(value).over(everything) + after * F.last(value).over(everything)) / (2 * half + 1)


def rolling_rate(seconds: str, frames: int, seq: str = "seq", order: str = "ord") -> Column:
    mean = F.avg(seconds).over(of(seq, order).rowsBetween(-(frames - 1), 0))
    return F.when(mean > 0, 1 / mean)


def run_length(df: DataFrame, failed: str, out: str, seq: str = "seq", order: str = "ord") -> DataFrame:
    """How many frames in a row have failed up to each one; 0 where one hasn't."""
    marked = df.withColumn("_run", F.sum(F.when(F.col(failed), 0).otherwise(1)).over(upto(seq, order)))
    count = F.sum(F.when(F.col(failed), 1).otherwise(0)).over(Window.partitionBy(seq, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn(out, count).drop("_run")


def segment(start: str, seq: str = "seq", order: str = "ord") -> Column:
    """The number of starts up to each frame: keyframes and what follows them share a number."""
    return F.sum(F.when(F.col(start), 1).otherwise(0)).over(upto(seq, order))


def frames_since(df: DataFrame, start: str, out: str, seq: str = "seq", order: str = "ord") -> DataFrame:
    """Frames since the last start, 0 at one; null before the first."""
    marked = df.withColumn("_segment", segment(start, seq, order))
    place = F.row_number().over(Window.partitionBy(seq, "_segment").orderBy(order)) - 1
    return marked.withColumn(out, F.when(F.col("_segment") > 0, place)).drop("_segment")


def filled_forward(value: str, seq: str = "seq", order: str = "ord") -> Column:
    return F.last(value, ignorenulls=True).over(upto(seq, order))


def interpolated(value: str, seq: str = "seq", order: str = "ord") -> Column:
    """Linear in ``order`` between known values, flat beyond the first and last."""
    before, after = upto(seq, order), of(seq, order).rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(order))
    low, high = F.last(value, True).over(before), F.first(value, True).over(after)
    low_at, high_at = F.last(at, True).over(before), F.first(at, True).over(after)
    part = (F.col(order) - low_at) / (high_at - low_at)
    return F.when(low.isNull(), high).when(high.isNull() | (high_at == low_at), low).otherwise(low + (high - low) * part)


def jump_allowed(df: DataFrame, x: str, y: str, start: str, out: str, history: int = 15, floor: float = 20.0, factor: float = 10.0) -> DataFrame:
    """False where a frame jumps further than 10 usual steps of its segment, and than 20 m, after 3 steps."""
    marked = df.withColumn("_segment", segment(start))
    w = Window.partitionBy("seq", "_segment").orderBy("ord")
    stepped = marked.withColumn("_step", step_length([x, y], w))
    last = w.rowsBetween(-history, -1)
    usual = F.percentile("_step", F.lit(0.5)).over(last)
    usual = F.when(usual <= 0, 2.0).otherwise(usual)
    enough = F.count("_step").over(last) >= 3
    return stepped.withColumn(out, ~F.coalesce(enough & (F.col("_step") > F.greatest(F.lit(floor), factor * usual)), F.lit(False))).drop("_segment", "_step")


def trimmed(df: DataFrame, valid: str, seq: str = "seq", order: str = "ord") -> DataFrame:
    """Without the invalid frames before the first and after the last valid one."""
    at, w = F.when(F.col(valid), F.col(order)), Window.partitionBy(seq)
    bounded = df.withColumn("_low", F.min(at).over(w)).withColumn("_high", F.max(at).over(w))
    return bounded.where(F.col(order).between(F.col("_low"), F.col("_high"))).drop("_low", "_high")


def sliding_samples(df: DataFrame, length: int, stride: int, shortest: int, seq: str = "seq", order: str = "ord") -> DataFrame:
    """(seq, start, frames): windows that start every ``stride`` frames, of ``length`` frames or what is left."""
    n = df.groupBy(seq).agg(F.count("*").alias("n")).where(F.col("n") >= shortest)
    starts = n.select(seq, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - shortest, F.lit(stride).cast("long"))).alias("start"))
    return starts.select(seq, "start", F.least(F.lit(length).cast("long"), F.col("n") - F.col("start")).alias("frames"))


def within_keyframes(df: DataFrame, start: str, most: int) -> DataFrame:
    """All frames up to the one that would start keyframe number ``most`` + 1."""
    starts = F.sum(F.when(F.col(start), 1).otherwise(0)).over(upto())
    return df.withColumn("_starts", starts - F.when(F.col(start), 1).otherwise(0)).where(F.col("_starts") < most).drop("_starts")
