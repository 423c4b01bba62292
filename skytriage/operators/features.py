"""Motion features of observed tracks.

One shuffle by track serves steps, moments, medians, heading counts and the vertical
series. Tracks beyond ``TRACK_LIMIT`` rows or frames take another way with the same
results: steps from joins on the row's position, medians from the ordered scan and the
spectrum from a transform spread over many tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from skytriage.constants import FEATURES, HOVER_SPEED, MIN_OBSERVATIONS
from skytriage.functions.geometry import corners, pixels_on_target
from skytriage.operators.scan import medians, ranked
from skytriage.operators.spectrum import distributed_spectrum
from skytriage.session import durable

#: Observations, or frames from first to last, up to which a track is handled in one task.
#: Any video inside the media limits (300 s at 120 fps) stays far below it. Frames without
#: observations cost nothing in a track whose height never changes: it has no spectrum.
TRACK_LIMIT = 500_000

_HEADINGS = 8


def duration_seconds(first: Column, last: Column, fps: Column) -> Column:
    return F.when(fps > 0, (last - first + 1) / fps).otherwise(0.0)


def track_summary(obs: DataFrame, fps: Column | float, keys: list[str] = ["track_id"]) -> DataFrame:
    """Counts, frame range, median size and duration per track."""
    rate = fps if isinstance(fps, Column) else F.lit(float(fps))
    sized = obs.withColumn("_px", pixels_on_target(corners())).withColumn("_fps", rate)
    base = sized.groupBy(*keys).agg(
        F.count("*").alias("n_observations"), F.min("frame_index").alias("first_frame"),
        F.max("frame_index").alias("last_frame"), F.max("_fps").alias("_fps"))
    mid = medians(sized, keys, "_px", "median_pixels_on_target")
    first, last = F.col("first_frame"), F.col("last_frame")
    return base.join(mid, keys).select(
        *keys, "n_observations", "first_frame", "last_frame", (last - first + 1).alias("span"),
        "median_pixels_on_target", duration_seconds(first, last, F.col("_fps")).alias("duration_seconds"))


def _measured(obs: DataFrame, keys: list[str]) -> DataFrame:
    return obs.select(
        *keys, F.col("frame_index").cast("long").alias("frame"),
        ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"),
        pixels_on_target(corners()).alias("px"))


def _step_columns(df: DataFrame) -> DataFrame:
    """Velocity and its change from the previous two rows (``p`` and ``pp``)."""
    def since(later: str, earlier: str) -> Column:
        gap = F.col(later) - F.col(earlier)
        return F.when(gap > 0, gap).when(gap.isNotNull(), F.raise_error(
            F.lit("frames of a track must be strictly increasing")).cast("long"))

    dt, dt0 = since("frame", "p.frame"), since("p.frame", "pp.frame")
    vx, vy = (F.col("cx") - F.col("p.cx")) / dt, (F.col("cy") - F.col("p.cy")) / dt
    ux, uy = (F.col("p.cx") - F.col("pp.cx")) / dt0, (F.col("p.cy") - F.col("pp.cy")) / dt0
    mid = (dt0 + dt) / 2.0
    return df.withColumns({
        "dt": dt, "vx": vx, "vy": vy, "speed": F.hypot(vx, vy),
        "path": F.hypot(F.col("cx") - F.col("p.cx"), F.col("cy") - F.col("p.cy")),
        "accel": F.hypot((vx - ux) / mid, (vy - uy) / mid),
        "scale": F.abs(F.col("px") / F.greatest(F.col("p.px"), F.lit(1e-6)) - 1) / dt,
    })


def steps(obs: DataFrame, keys: list[str] = ["track_id"]) -> DataFrame:
    """One row per observation with the step that led to it (null on the first)."""
    w = Window.partitionBy(*keys).orderBy("frame")
    row = F.struct("frame", "cx", "cy", "px")
    m = _measured(obs, keys).withColumns({"p": F.lag(row, 1).over(w), "pp": F.lag(row, 2).over(w)})
    return _step_columns(m).drop("p", "pp")


def _with_neighbours(placed: DataFrame, keys: list[str], back: dict[str, int]) -> DataFrame:
    """Rows with the rows so many positions back (negative: ahead), for tracks of any length.

    ``placed`` has ``position``; neighbours meet on (track, position), which spreads one
    track over all tasks.
    """
    out = placed
    for name, n in back.items():
        other = placed.select(*keys, (F.col("position") + n).alias("position"), F.struct("frame", "cx", "cy", "px").alias(name))
        out = out.join(other, [*keys, "position"], "left")
    return out


def _angle() -> Column:
    """Direction of (vx, vy), on the diagonals rounded from the exact angle.

    The borders of the heading bins lie there, and ``atan2`` of the JVM rounds the quotient
    first, which puts a step on a diagonal an ulp beside it. Near one the angle is the
    diagonal's, in two parts, and a small rest.
    """
    x, y = F.abs("vx"), F.abs("vy")
    rest = (y - x) / F.greatest(x + y, F.lit(1e-300))
    ahead, back = (F.lit(hi) + (F.lit(lo) + r) for hi, lo, r in ((0.7853981633974483, 3.061616997868383e-17, rest), (2.356194490192345, 9.184850993605148e-17, -rest)))
    near = F.when(F.col("vx") > 0, ahead).otherwise(back)
    return F.when(F.abs(rest) < 1e-9, F.when(F.col("vy") < 0, -near).otherwise(near)).otherwise(F.atan2("vy", "vx"))


def _heading_bin() -> Column:
    width = 2 * math.pi / _HEADINGS
    raw = F.floor((_angle() + math.pi) / width)
    return F.when(F.col("speed") > 1e-9, F.least(raw, F.lit(_HEADINGS - 1)))


def _moments(keys: list[str]) -> list[Column]:
    place = F.struct("frame", "cx", "cy")
    return [
        F.count("*").alias("n_observations"),
        F.min(place).alias("_first"), F.max(place).alias("_last"),
        F.avg("speed").alias("mean_speed"), F.var_pop("speed").alias("speed_variance"),
        F.var_pop("accel").alias("acceleration_variance"),
        F.sum("path").alias("_path"), F.max("_hover_speed").alias("_hover_speed"),
        F.avg((F.col("speed") < F.col("_hover_speed")).cast("double")).alias("hover_fraction"),
        *[F.count_if(F.col("_bin") == b).alias(f"_h{b}") for b in range(_HEADINGS)],
    ]


def _derived(df: DataFrame, keys: list[str]) -> DataFrame:
    moving = sum((F.col(f"_h{b}") for b in range(_HEADINGS)), F.lit(0))
    entropy = F.lit(0.0)
    for b in range(_HEADINGS):
        p = F.col(f"_h{b}") / moving
        entropy = entropy - F.when(F.col(f"_h{b}") > 0, p * F.log2(p)).otherwise(0.0)
    gone = F.hypot(F.col("_last.cx") - F.col("_first.cx"), F.col("_last.cy") - F.col("_first.cy"))
    return df.select(
        *keys, "n_observations", (F.col("_last.frame") - F.col("_first.frame") + 1).alias("duration_frames"),
        "mean_speed", "speed_variance", "acceleration_variance",
        F.col("_spectrum.hz").alias("vertical_oscillation_hz"),
        F.col("_spectrum.power").alias("vertical_oscillation_power"),
        F.when(moving < 2, 0.0).otherwise(entropy / math.log2(_HEADINGS)).alias("heading_entropy"),
        "hover_fraction", (F.col("_path") / F.greatest(gone, F.lit(1e-6))).alias("trajectory_smoothness"),
        "scale_change_rate", "median_pixels_on_target")


def spectrum_of(frames: np.ndarray, signal: np.ndarray, fps: float) -> tuple[float, float]:
    """Dominant frequency (Hz) and its share of the power above the constant term."""
    n = int(frames[-1] - frames[0]) + 1
    if n < MIN_OBSERVATIONS or signal.min() == signal.max():
        return 0.0, 0.0
    grid = np.arange(n, dtype=np.float64)
    level = np.interp(grid, (frames - frames[0]).astype(np.float64), signal)
    t = grid - grid.mean()
    level = level - level.mean()
    level = level - t * (t @ level) / (t @ t)
    if np.all(np.abs(level) <= 1e-8):
        return 0.0, 0.0
    power = np.abs(np.fft.rfft(level * np.hanning(n))[1:]) ** 2
    total = float(power.sum())
    peak = int(np.argmax(power))
    return (peak + 1) * fps / n, (float(power[peak]) / total if total > 0 else 0.0)


@F.pandas_udf(T.StructType([T.StructField("hz", T.DoubleType()), T.StructField("power", T.DoubleType())]))
def _spectrum(frames: pd.Series, signal: pd.Series, fps: pd.Series) -> pd.DataFrame:
    out = [spectrum_of(np.asarray(f), np.asarray(s), r) for f, s, r in zip(frames, signal, fps)]
    return pd.DataFrame(out, columns=["hz", "power"])


def track_features(obs: DataFrame, fps: Column | float = 30.0, hover_speed: float = HOVER_SPEED,
                   keys: list[str] = ["track_id"], track_limit: int = TRACK_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(one row of features per track, tracks too short to have any).

    A frame rate that is missing or not positive counts as 30.
    """
    rate = fps if isinstance(fps, Column) else F.lit(float(fps))
    rate = F.when(rate > 0, rate.cast("double")).otherwise(30.0)
    sizes = obs.groupBy(*keys).agg(F.count("*").alias("n_observations"),
                                   (F.max("frame_index") - F.min("frame_index") + 1).alias("_span"),
                                   (F.min(F.col("y1") + F.col("y2")) < F.max(F.col("y1") + F.col("y2"))).alias("_moves"),
                                   F.max(rate).alias("_fps"))
    too_short = sizes.where(F.col("n_observations") < MIN_OBSERVATIONS).select(*keys, "n_observations")
    is_long = (F.col("n_observations") > track_limit) | (F.col("_moves") & (F.col("_span") > track_limit))
    heavy = sizes.where(is_long & (F.col("n_observations") >= MIN_OBSERVATIONS)).select(*keys, "_span", "_fps")
    has_heavy = not heavy.isEmpty()
    rated = obs.withColumn("_fps", rate)
    usual = rated
    if has_heavy:
        heavy = durable(heavy)
        usual = rated.join(heavy.select(*keys), keys, "left_anti")
    w = Window.partitionBy(*keys).orderBy("frame")
    row = F.struct("frame", "cx", "cy", "px")
    measured = _measured(usual, keys + ["_fps"]).withColumns({"p": F.lag(row, 1).over(w), "pp": F.lag(row, 2).over(w)})
    stepped = _step_columns(measured).withColumn("_hover_speed", F.lit(hover_speed)).withColumn("_bin", _heading_bin())
    series = F.sort_array(F.collect_list(F.struct("frame", "cy"))).alias("_series")
    grouped = stepped.groupBy(*keys).agg(
        *_moments(keys), F.expr("percentile(scale, 0.5D)").alias("scale_change_rate"),
        F.expr("percentile(px, 0.5D)").alias("median_pixels_on_target"), series, F.max("_fps").alias("_fps"),
    ).where(F.col("n_observations") >= MIN_OBSERVATIONS)
    out = _derived(grouped.withColumn(
        "_spectrum", _spectrum(F.col("_series.frame"), F.col("_series.cy"), F.col("_fps"))), keys)
    if has_heavy:
        out = out.unionByName(_long_features(rated.join(heavy, keys, "left_semi"), heavy, hover_speed, keys))
    return out, too_short


def _long_features(obs: DataFrame, heavy: DataFrame, hover_speed: float, keys: list[str]) -> DataFrame:
    placed = durable(ranked(_measured(obs, keys), keys, [F.col("frame")]))
    stepped = durable(_step_columns(_with_neighbours(placed, keys, {"p": 1, "pp": 2})).drop("p", "pp", "position")
                      .withColumn("_hover_speed", F.lit(hover_speed)).withColumn("_bin", _heading_bin()))
    series = _between(_with_neighbours(placed, keys, {"_next": -1}), keys)
    return _derived(
        stepped.groupBy(*keys).agg(*_moments(keys))
        .join(medians(stepped.where("scale IS NOT NULL"), keys, "scale", "scale_change_rate", limit=0), keys)
        .join(medians(stepped, keys, "px", "median_pixels_on_target", limit=0), keys)
        .join(distributed_spectrum(series, heavy.select(*keys, "_fps"), keys), keys), keys)


def resample(measured: DataFrame, keys: list[str] = ["track_id"]) -> DataFrame:
    """Vertical centre on every integer frame from first to last, linear between rows."""
    w = Window.partitionBy(*keys).orderBy("frame")
    return _between(measured.withColumn("_next", F.lead(F.struct("frame", "cy")).over(w)), keys)


def _between(nxt: DataFrame, keys: list[str]) -> DataFrame:
    inside = F.sequence(F.col("frame"), F.greatest(F.col("frame"), F.coalesce(F.col("_next.frame"), F.col("frame") + 1) - 1))
    slope = F.coalesce((F.col("_next.cy") - F.col("cy")) / (F.col("_next.frame") - F.col("frame")), F.lit(0.0))
    return nxt.select(*keys, F.explode(inside).alias("at"), "frame", "cy", slope.alias("_m")).select(
        *keys, F.col("at").alias("frame"), (F.col("cy") + F.col("_m") * (F.col("at") - F.col("frame"))).alias("cy"))


def detrend(series: DataFrame, keys: list[str] = ["track_id"]) -> DataFrame:
    """Resampled series minus its least-squares line; a flat remainder becomes exact zeros."""
    t = F.col("frame").cast("double")
    line = series.groupBy(*keys).agg(
        F.regr_slope(F.col("cy"), t).alias("_m"), F.regr_intercept(F.col("cy"), t).alias("_b"))
    rest = F.col("cy") - (F.col("_m") * t + F.col("_b"))
    return series.join(line, keys).select(*keys, "frame", rest.alias("rest"))


def feature_vector(features: DataFrame) -> DataFrame:
    """The nine classifier inputs in their fixed order, as one array column."""
    return features.withColumn("features", F.array(*FEATURES))
