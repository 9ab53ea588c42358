"""Search responses: JSON objects with an ``organic`` list of results in rank order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESPONSE = "organic ARRAY<STRUCT<link: STRING>>"


def search_results(responses: DataFrame, body: str = "response") -> DataFrame:
    """(service_num, rank, link) from (service_num, JSON text). Without results there are no rows."""
    parsed = F.from_json(body, RESPONSE)
    return responses.select(
        "service_num", F.posexplode(parsed["organic"]).alias("rank", "result")
    ).select("service_num", (F.col("rank") + 1).alias("rank"), F.col("result.link").alias("link"))
