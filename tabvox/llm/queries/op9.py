"""Query of operator 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabvox.llm import html_text
from tabvox.llm.queries.tables import read


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(read(spark, sf_dir, "pages").select("page_id", "html"))
    return out.withColumns({"n_chars": F.length("text").cast("long"), "n_lines": F.size(F.split("text", "\n")).cast("long")})
