"""Track summaries and motion features (D5, E)."""

from pyspark.sql import functions as F

from skytriage.constants import FEATURES
from skytriage.operators import features as ft
from skytriage.plans import sqlbits as s
from skytriage.plans.fixtures import ctes, view
from skytriage.plans.registry import query

_OBS = ctes("fx_observations")

STEPS_SQL = f"""
    m AS (SELECT track_id, frame_index AS frame, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, {s.px('o')} AS px
          FROM fx_observations o),
    l AS (SELECT *, lag(frame) OVER w AS pf, lag(cx) OVER w AS pcx, lag(cy) OVER w AS pcy, lag(px) OVER w AS ppx
          FROM m WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
    v AS (SELECT *, frame - pf AS dt, (cx - pcx) / (frame - pf) AS vx, (cy - pcy) / (frame - pf) AS vy FROM l),
    st AS (SELECT *, sqrt(vx * vx + vy * vy) AS speed, lag(vx) OVER w AS pvx, lag(vy) OVER w AS pvy,
                  lag(dt) OVER w AS pdt, sqrt((cx - pcx)**2 + (cy - pcy)**2) AS path
           FROM v WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
    steps AS (SELECT *, sqrt(((vx - pvx) / ((dt + pdt) / 2.0))**2 + ((vy - pvy) / ((dt + pdt) / 2.0))**2) AS accel,
                     abs(px / greatest(ppx, 1e-6) - 1) / dt AS scale,
                     CASE WHEN speed > 1e-9 THEN least(floor((atan2(vy, vx) + pi()) / (pi() / 4)), 7) END AS hb
              FROM st)"""

SPECTRUM_SQL = """
    seg AS (SELECT track_id, frame, cy, lead(frame) OVER w AS nf, lead(cy) OVER w AS ncy
            FROM m WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
    series AS (SELECT track_id, unnest(range(frame, coalesce(nf, frame + 1))) AS f_at, frame, cy, nf, ncy FROM seg),
    grid AS (SELECT track_id, f_at AS frame, cy + coalesce((ncy - cy) / (nf - frame), 0) * (f_at - frame) AS cy FROM series),
    line AS (SELECT track_id, avg(cy) AS my, avg(frame) AS mt,
                    regr_slope(cy, frame) AS slope, count(*) AS n, min(frame) AS f0 FROM grid GROUP BY 1),
    rest AS (SELECT g.track_id, g.frame, g.frame - l.f0 AS t, l.n,
                    g.cy - l.my - l.slope * (g.frame - l.mt) AS rest FROM grid g JOIN line l USING (track_id)),
    ks AS (SELECT track_id, n, unnest(range(1, n // 2 + 1)) AS k FROM line),
    dft AS (SELECT ks.track_id, ks.k, ks.n,
                   sum(r.rest * (0.5 - 0.5 * cos(2 * pi() * r.t / (r.n - 1))) * cos(2 * pi() * ((ks.k * r.t) % ks.n) / ks.n))**2
                 + sum(r.rest * (0.5 - 0.5 * cos(2 * pi() * r.t / (r.n - 1))) * sin(2 * pi() * ((ks.k * r.t) % ks.n) / ks.n))**2 AS pw
            FROM ks JOIN rest r USING (track_id) GROUP BY 1, 2, 3),
    spec AS (SELECT track_id, arg_max(k, pw) * 30.0 / any_value(n) AS hz, max(pw) / sum(pw) AS power FROM dft GROUP BY 1)"""

FEATURES_SQL = f"""{STEPS_SQL}, {SPECTRUM_SQL},
    heads AS (SELECT track_id, hb, count(*) AS c FROM steps WHERE hb IS NOT NULL GROUP BY 1, 2),
    entropy AS (SELECT track_id, CASE WHEN sum(c) < 2 THEN 0 ELSE
                  -sum((c / tot) * log2(c / tot)) / 3 END AS h
                FROM (SELECT *, sum(c) OVER (PARTITION BY track_id) AS tot FROM heads) GROUP BY track_id),
    features AS (
      SELECT s.track_id, count(*) AS n_observations, CAST(max(frame) - min(frame) + 1 AS BIGINT) AS duration_frames,
             avg(speed) AS mean_speed, var_pop(speed) AS speed_variance, var_pop(accel) AS acceleration_variance,
             any_value(spec.hz) AS vertical_oscillation_hz, any_value(spec.power) AS vertical_oscillation_power,
             coalesce(any_value(e.h), 0) AS heading_entropy,
             avg(CASE WHEN speed < 0.5 THEN 1.0 WHEN speed >= 0.5 THEN 0.0 END) AS hover_fraction,
             sum(path) / greatest(sqrt((arg_max(cx, frame) - arg_min(cx, frame))**2
                                     + (arg_max(cy, frame) - arg_min(cy, frame))**2), 1e-6) AS trajectory_smoothness,
             quantile_cont(scale, 0.5) AS scale_change_rate, quantile_cont(px, 0.5) AS median_pixels_on_target
      FROM steps s LEFT JOIN spec USING (track_id) LEFT JOIN entropy e USING (track_id)
      GROUP BY s.track_id HAVING count(*) >= 8)"""

_DIGITS = {"trajectory_smoothness": 4, "acceleration_variance": 4, "speed_variance": 4}


def rounded_features(df):
    for c in (*FEATURES, "median_pixels_on_target"):
        df = df.withColumn(c, F.round(c, _DIGITS.get(c, 6)))
    return df


def rounded_sql(cols=(*FEATURES, "median_pixels_on_target")):
    return ", ".join(f"round({c}, {_DIGITS.get(c, 6)}) AS {c}" for c in cols)


@query("d5_track_summary", _OBS + f"""
  SELECT track_id, count(*) AS n_observations, min(frame_index) AS first_frame, max(frame_index) AS last_frame,
         max(frame_index) - min(frame_index) + 1 AS span, round(quantile_cont({s.px('o')}, 0.5), 6) AS median_pixels_on_target,
         round((max(frame_index) - min(frame_index) + 1) / 30.0, 6) AS duration_seconds
  FROM fx_observations o GROUP BY track_id""")
def summary(spark, sf):
    out = ft.track_summary(view(spark, sf, "fx_observations"), 30.0)
    return (out.withColumn("median_pixels_on_target", F.round("median_pixels_on_target", 6))
            .withColumn("duration_seconds", F.round("duration_seconds", 6)))


@query("e1_steps", f"{_OBS}, {STEPS_SQL}" + """
  SELECT track_id, frame, dt, round(vx, 6) AS vx, round(vy, 6) AS vy, round(speed, 6) AS speed, round(accel, 6) AS accel
  FROM steps""")
def steps(spark, sf):
    out = ft.steps(view(spark, sf, "fx_observations"))
    return out.select("track_id", "frame", "dt", *[F.round(c, 6).alias(c) for c in ("vx", "vy", "speed", "accel")])


@query("e9_e10_resample_detrend", f"{_OBS}, {STEPS_SQL}, {SPECTRUM_SQL}" + """
  SELECT track_id, frame, round(rest, 4) + 0.0 AS rest FROM rest""")
def resampled(spark, sf):
    measured = ft._measured(view(spark, sf, "fx_observations"), ["track_id"])
    out = ft.detrend(ft.resample(measured))
    return out.select("track_id", "frame", (F.round("rest", 4) + 0.0).alias("rest"))


@query("e2_e13_track_features", f"{_OBS}, {FEATURES_SQL} SELECT track_id, n_observations, duration_frames, {rounded_sql()} FROM features")
def features(spark, sf):
    return rounded_features(ft.track_features(view(spark, sf, "fx_observations"), 30.0)[0])
