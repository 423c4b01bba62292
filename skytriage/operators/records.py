"""Table-level reads of stored jobs, decisions and accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from skytriage.operators.scan import prefix_scan, with_blocks

# Field names whose values are never shown in full. Fixed values.
SENSITIVE = ("password", "new_password", "current_password", "token", "session_token", "csrf_token",
             "password_hash", "token_hash", "secret", "api_key", "authorization", "cookie")


def owned(df: DataFrame, owner) -> DataFrame:
    """Rows of one owner; a row of somebody else looks exactly like a missing one."""
    return df.where(F.col("owner_id") == owner)


def newest_videos(videos: DataFrame, owner) -> DataFrame:
    return owned(videos, owner).orderBy(F.desc("created_at"), F.desc("video_id"))


def job_results(jobs: DataFrame, tracks: DataFrame, owner, features: str) -> DataFrame:
    """Tracks of an owner's jobs by number, with ``features`` parsed by the given schema."""
    mine = owned(jobs, owner).select("job_id", "video_id", "status")
    return mine.join(tracks, "job_id").withColumn("features", F.from_json("features_json", features)).drop("features_json").orderBy("job_id", "track_number")


def job_decisions(decisions: DataFrame, owner, job_id) -> DataFrame:
    return owned(decisions, owner).where(F.col("job_id") == job_id).orderBy("created_at", "decision_id")


def decision_detail(decisions: DataFrame, feedback: DataFrame, owner, decision_id) -> DataFrame:
    """One decision with the feedback on it, oldest first."""
    one = owned(decisions, owner).where(F.col("decision_id") == decision_id)
    said = feedback.where(F.col("decision_id") == decision_id).groupBy("decision_id").agg(
        F.sort_array(F.collect_list(F.struct("received_at", "response", "responder"))).alias("feedback"))
    return one.join(said, "decision_id", "left").withColumn("feedback", F.coalesce("feedback", F.array()))


def quota_usage(videos: DataFrame, owners: DataFrame) -> DataFrame:
    """Bytes stored per owner against their quota, owners without videos included."""
    used = videos.groupBy("owner_id").agg(F.sum("size_bytes").alias("used_bytes"))
    return owners.select("owner_id", "quota_bytes").join(used, "owner_id", "left").fillna(0, ["used_bytes"]).withColumn(
        "over_quota", F.col("used_bytes") > F.col("quota_bytes"))


def redact_value(value: Column) -> Column:
    text = value.cast("string")
    return (F.when(text.isNull() | (text == ""), "-").when(F.length(text) <= 8, F.repeat(F.lit("*"), F.length(text)))
            .otherwise(F.concat(F.substring(text, 1, 8), F.lit("..."))))


def _redacted(value: Column, kind: T.DataType, keys: tuple[str, ...]) -> Column:
    if isinstance(kind, T.StructType):
        inner = [(redact_value(value[f.name]) if f.name.lower() in keys else _redacted(value[f.name], f.dataType, keys)).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*inner))
    if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.StringType):
        return F.transform_values(value, lambda k, v: F.when(F.lower(k).isin(*keys), redact_value(v)).otherwise(v))
    return value


def redact(df: DataFrame, keys: tuple[str, ...] = SENSITIVE) -> DataFrame:
    """Sensitive fields cut to a short prefix, at any nesting of structs and string maps."""
    keys = tuple(k.lower() for k in keys)
    return df.select(*[
        (redact_value(F.col(f"`{f.name}`")) if f.name.lower() in keys else _redacted(F.col(f"`{f.name}`"), f.dataType, keys)).alias(f.name)
        for f in df.schema.fields])


def lockout_delay(failures: Column) -> Column:
    """Seconds to wait after so many failures in a row: three are free, then doubling to 900."""
    power = F.pow(F.lit(2.0), F.least(failures - 4, F.lit(20)).cast("double"))
    return F.when(failures > 3, F.least(power, F.lit(900.0))).otherwise(0.0)


def lockout_streaks(logins: DataFrame) -> DataFrame:
    """Login log with ``consecutive_failures`` and the ``delay_seconds`` it imposes.

    ``logins`` has ``account, at, attempt_id, ok``. A streak is the failures so far minus
    those up to the last success, both running values, so one account may hold any share
    of the log.
    """
    order = [F.col("at"), F.col("attempt_id")]
    blocked = with_blocks(logins, [F.col("account"), *order])
    counted = prefix_scan(blocked, ["account"], order, sums={"_fails": (~F.col("ok")).cast("long")})
    reset = prefix_scan(counted, ["account"], order, maxes={"_base": F.when(F.col("ok"), F.col("_fails"))})
    streak = F.col("_fails") - F.coalesce("_base", F.lit(0))
    return reset.select(*logins.columns, streak.alias("consecutive_failures"), lockout_delay(streak).alias("delay_seconds"))
