"""How queries register themselves, and the inputs they share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def flagged(spark, d: str, flag: str) -> DataFrame:
    """Order keys (id) with a line of this return flag."""
    return table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("id")).distinct()


def supply_edges(spark, d: str) -> DataFrame:
    """(kind, in1, out): suppliers to parts, of all lines."""
    kind = F.element_at(F.array(F.lit("close"), F.lit("connect"), F.lit("combine")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return table(spark, d, "lineitem").select(kind.alias("kind"), F.col("l_suppkey").alias("in1"), F.col("l_partkey").alias("out")).distinct()


#: supply_edges in SQL.
EDGES = "SELECT DISTINCT CASE l_linenumber % 3 WHEN 0 THEN 'close' WHEN 1 THEN 'connect' ELSE 'combine' END AS kind, l_suppkey AS in1, l_partkey AS out FROM lineitem"


def day_words(spark, d: str) -> DataFrame:
    """(user_id, day, word): each user's event types of a day in order, as symbols 0 to 4."""
    e = table(spark, d, "events")
    symbol = F.array_position(F.array(*map(F.lit, ("view", "click", "purchase", "error", "signup"))), F.col("event_type")).cast("int") - 1
    items = F.array_sort(F.collect_list(F.struct("ts", "event_id", symbol.alias("x"))))
    words = e.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(items.alias("w"))
    return words.select("user_id", "day", F.transform("w", lambda x: x["x"]).alias("word"))


WORDS = """SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, string_agg(CASE event_type WHEN 'view' THEN '0' WHEN 'click' THEN '1' WHEN 'purchase' THEN '2' WHEN 'error' THEN '3' ELSE '4' END, '' ORDER BY ts, event_id) AS w FROM events GROUP BY 1, 2"""


def islands_sql(ids: str, by: str = "") -> str:
    """Islands of a query's `id`, for each `by`."""
    cols = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"SELECT {cols}min(id) AS lo, max(id) + 1 AS hi FROM (SELECT {cols}id, id - row_number() OVER ({part}ORDER BY id) AS g FROM (SELECT DISTINCT {cols}id FROM ({ids}))) GROUP BY {cols}g"


def row_window(*keys: str):
    return Window.partitionBy(*keys)
