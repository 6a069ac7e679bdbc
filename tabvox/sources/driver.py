"""The driver's tables in the engine's roles: the same mapping as Spark columns and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (source table, select list valid in both Spark SQL and DuckDB, filter)
ROLES = {
    "objects": (
        "lineitem",
        "concat('A', cast(l_suppkey as varchar(20))) AS animal, l_returnflag AS channel, cast(l_orderkey % 8 as int) AS section, l_orderkey * 10 + l_linenumber AS label, "
        "CASE WHEN l_linenumber = 7 THEN 0.0 ELSE cast(l_quantity as double) END AS volume, l_extendedprice / 100 AS surface, l_extendedprice AS intden, l_discount AS mean, "
        "cast(l_partkey % 64 as double) AS x, cast(l_orderkey % 64 as double) AS y, cast(l_linenumber as double) AS z, l_tax * 1000 AS overlap, cast(l_partkey % 5 as int) AS cluster, cast(l_linenumber % 2 as int) AS marker, l_linestatus AS run_id",
    ),
    "voxels": ("lineitem", "l_returnflag AS channel, cast(l_linenumber as int) AS z, cast(l_orderkey % 64 as int) AS y, cast(l_partkey % 64 as int) AS x, avg(l_quantity) AS value", "GROUP BY 1, 2, 3, 4"),
    "points": ("events", "cast(user_id % 10 as int) AS section, event_id AS id, event_type AS type, cast((event_id * 7919) % 1009 as double) / 1009 * 100 AS x, cast((event_id * 104729) % 2003 as double) / 2003 * 100 AS y, value AS mark"),
    # cents are summed exactly: equal means are then equal numbers in any order of summing, so that ties are ties
    "samples": ("orders", "o_orderpriority AS condition, o_custkey AS subject, o_orderstatus AS metric, cast(sum(try_cast(o_totalprice as decimal(18,2))) as double) / count(try_cast(o_totalprice as decimal(18,2))) AS value", "GROUP BY 1, 2, 3"),
}


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns, *rest = ROLES[name]
    df = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    return spark.sql(f"SELECT {columns} FROM {{df}} {' '.join(rest)}", df=df)


def role_sql(*names: str) -> str:
    """WITH clause that defines the roles."""
    return "WITH " + ", ".join(f"{n} AS (SELECT {ROLES[n][1]} FROM {ROLES[n][0]} {' '.join(ROLES[n][2:])})" for n in names)
