"""Views over the shared tables, in SQL that both engines accept.

``{name}`` stands for a table: a DataFrame on the Spark side, the registered view on the
side of the checking database.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

VIEWS: dict[str, str] = {
    "fx_detections": """
        SELECT l_suppkey AS source_video, l_orderkey % 120 AS frame_index,
               CAST(ROW_NUMBER() OVER (PARTITION BY l_suppkey, l_orderkey % 120
                    ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS BIGINT) AS det_index,
               CAST((l_partkey * 7) % 1800 + (l_orderkey % 5) AS DOUBLE) AS x1,
               CAST((l_orderkey * 3) % 1000 AS DOUBLE) AS y1,
               CAST((l_partkey * 7) % 1800 + (l_orderkey % 5) + 3 + l_partkey % 45 AS DOUBLE) AS x2,
               CAST((l_orderkey * 3) % 1000 + 3 + l_orderkey % 45 AS DOUBLE) AS y2,
               CAST((l_orderkey * 31 + l_partkey * 17 + l_linenumber * 7) % 1000 AS DOUBLE) / 1000 AS score
        FROM {lineitem}""",
    "fx_ground_truth": """
        SELECT l_suppkey AS source_video, l_orderkey % 120 AS frame_index,
               CAST(ROW_NUMBER() OVER (PARTITION BY l_suppkey, l_orderkey % 120
                    ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS BIGINT) AS gt_index,
               CAST((l_partkey * 7) % 1800 + 2 AS DOUBLE) AS x1,
               CAST((l_orderkey * 3) % 1000 AS DOUBLE) AS y1,
               CAST((l_partkey * 7) % 1800 + 5 + l_partkey % 45 AS DOUBLE) AS x2,
               CAST((l_orderkey * 3) % 1000 + 3 + l_orderkey % 45 AS DOUBLE) AS y2,
               CASE l_returnflag WHEN 'R' THEN 'drone' WHEN 'A' THEN 'bird' ELSE 'aircraft' END AS label
        FROM {lineitem} WHERE l_linenumber <= 4""",
    "fx_observations": """
        SELECT CONCAT('t', CAST(user_id AS STRING)) AS track_id, user_id % 20 AS source_clip,
               user_id % 5 AS site_id,
               CAST(3 * ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) + event_id % 3 AS frame_index,
               value * 2 + 10 AS x1, CAST(event_id % 97 AS DOUBLE) AS y1,
               value * 2 + 16 + user_id % 30 AS x2, CAST(event_id % 97 + 6 + user_id % 30 AS DOUBLE) AS y2,
               CASE user_id % 3 WHEN 0 THEN 'drone' WHEN 1 THEN 'bird' ELSE 'aircraft' END AS label,
               ts AS observed_at
        FROM {events}""",
    "fx_authorized_flights": """
        SELECT o_orderkey AS flight_id, o_custkey % 50 AS site_id, o_orderdate AS starts_at,
               o_orderdate + INTERVAL '36' HOUR AS ends_at
        FROM {orders}""",
    "fx_sightings": """
        SELECT l_suppkey AS source_video, l_orderkey % 120 AS frame_index, l_partkey % 50 AS site_id,
               l_shipdate AS observed_at
        FROM {lineitem}""",
}

_FRAMES_SQL = """
        SELECT s_suppkey AS source_video, f.frame_index
        FROM supplier CROSS JOIN (SELECT DISTINCT o_orderkey % 120 AS frame_index FROM orders) f"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "fx_frames":
        # The frame numbers are remainders of 120, so there are at most 120. Written as a product
        # for its size: an exploded array is taken for no larger than its input, and frames were
        # then sent whole to the driver as the small side of joins.
        numbers = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 120).alias("frame_index")).distinct()
        return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_video")).crossJoin(F.broadcast(numbers))
    text = VIEWS[name]
    used = [t for t in TABLES if "{" + t + "}" in text]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def ctes(*names: str) -> str:
    """``WITH`` clause that defines the named views for the checking side."""
    parts = []
    for name in names:
        text = _FRAMES_SQL if name == "fx_frames" else VIEWS[name].format(**{t: t for t in TABLES})
        parts.append(f"{name} AS ({text})")
    return "WITH RECURSIVE " + ",\n".join(parts)
