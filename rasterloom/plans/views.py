"""Inputs of the reference's shape, derived from the driver's tables by integer arithmetic.

Each text is a SELECT that both Spark and the oracle run, so the operators above
it start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # dx and dy are multiples of 1/8, so sums of them are exact in any order
    "correspondence": """
        SELECT cast(l_suppkey AS bigint) AS pair_id, (cast(l_orderkey AS bigint) * 10 + l_linenumber) * 100000 + l_partkey AS match_id,
               cast(l_partkey % 500 AS double) AS src_x, cast(l_orderkey % 400 AS double) AS src_y,
               cast(l_partkey % 500 AS double) + 3 + (l_linenumber % 5) * cast(0.25 AS double) + CASE WHEN l_orderkey % 97 = 0 THEN 500 ELSE 0 END AS dst_x,
               cast(l_orderkey % 400 AS double) - 2 + (l_orderkey % 9) * cast(0.125 AS double) + CASE WHEN l_orderkey % 97 = 0 THEN 300 ELSE 0 END AS dst_y,
               cast((l_orderkey * 7 + l_linenumber) % 100 AS double) / 100 AS confidence, concat(l_returnflag, l_linestatus) AS method
        FROM lineitem""",
    "raster": """
        SELECT cast(s_suppkey AS bigint) AS raster_id, cast(400 + (s_suppkey % 7) * 100 AS bigint) AS width, cast(300 + (s_suppkey % 5) * 100 AS bigint) AS height,
               cast(-123.5 AS double) + cast(s_suppkey % 20 AS double) / 64 AS a_left, cast(49 AS double) + cast(s_suppkey % 10 AS double) / 64 AS a_bottom,
               cast(4326 AS int) AS epsg
        FROM supplier""",
    "raster_bounds": """
        SELECT raster_id, width, height, epsg, a_left AS "left", a_bottom AS bottom, a_left + cast(width AS double) / 4096 AS "right", a_bottom + cast(height AS double) / 4096 AS top,
               cast(1 AS double) / 4096 AS a, cast(0 AS double) AS b, a_left AS c, cast(0 AS double) AS d, cast(-1 AS double) / 4096 AS e, a_bottom + cast(height AS double) / 4096 AS f
        FROM raster""",
    "gcp": """
        SELECT cast(c_custkey AS bigint) AS gcp_id, cast(-123.5 AS double) + cast(c_custkey % 1000 AS double) / 2048 AS lon, cast(49 AS double) + cast(c_custkey % 997 AS double) / 2048 AS lat,
               cast(c_custkey % 50 AS double) AS z, CASE WHEN c_custkey % 7 = 0 THEN '0' ELSE '1' END AS enabled
        FROM customer""",
    "pixel": """
        SELECT cast(floor((p_partkey - 1) / 1024) AS bigint) AS raster_id, cast(floor(((p_partkey - 1) % 1024) / 32) AS int) AS "row", cast((p_partkey - 1) % 32 AS int) AS col,
               cast(CASE WHEN p_partkey % 61 < 4 THEN 0 ELSE (p_partkey * 7 + p_size * 13) % 256 END AS int) AS value
        FROM part""",
    "steps": """
        SELECT cast(r_regionkey + 1 AS int) AS step, cast(r_regionkey + 1 AS double) / 8 AS scale, cast(3 - r_regionkey AS double) * 4 AS shift_x, cast(r_regionkey * 2 - 3 AS double) * 2 AS shift_y
        FROM region""",
    "cells": "SELECT lpad(lower(hex(p_partkey % 500 + 4096)), 15, '8') AS cell FROM part",
    "debug_event": "SELECT event_id, event_type, value, props FROM events",
}
ORDER = ("correspondence", "raster", "raster_bounds", "gcp", "pixel", "steps", "cells", "debug_event")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame; the tables that it reads are named by path, so nothing is registered."""
    text = VIEWS[name].replace('"', "`")
    for table in ("lineitem", "supplier", "customer", "part", "region", "events"):
        text = text.replace(f"FROM {table}", f"FROM parquet.`{sf_dir}/{table}.parquet`")
    if "FROM raster" in text:
        text = text.replace("FROM raster", f"FROM ({VIEWS['raster']})".replace("FROM supplier", f"FROM parquet.`{sf_dir}/supplier.parquet`"))
    return spark.sql(text)


def with_views(sql: str) -> str:
    """The oracle's text: the views that it names come before it."""
    used = [v for v in ORDER if v in sql or v == "raster" and "raster_bounds" in sql]
    return "WITH " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in used) + " " + sql if used else sql
