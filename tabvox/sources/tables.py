"""Readers and writers of measurement tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tabvox.functions.names import safe_cell
from tabvox.functions.scalar import finite

#: fixed values: names under which rosters give the animal
ROSTER_NAMES = ("animal", "animalname", "animalid", "subject", "subjectid", "mouse", "mouseid", "id")


def read_measurements(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as text, headers trimmed, blank records left out; quotes are doubled within quotes, records may span lines."""
    df = spark.read.csv(path, header=True, sep=sep, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")
    df = df.toDF(*[c.strip() for c in df.columns])
    blank = F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in df.columns]) if df.columns else F.lit(None)
    return df.where(blank.isNotNull())


def typed(df: DataFrame, numbers: list[str]) -> DataFrame:
    """The named columns as finite numbers or null."""
    return df.withColumns({c: finite(F.col(f"`{c}`")) for c in numbers})


def channel_from_file(df: DataFrame) -> DataFrame:
    """Add channel: the name of the file that a row is from, without its ending. Call it on a frame read from files."""
    return df.withColumn("channel", F.regexp_replace(F.col("_metadata.file_name"), r"(\.csv|\.tsv|\.parquet|\.json)+$", ""))


def publish(df: DataFrame, path: str, fmt: str = "csv", least: int = 0, keep: int = 2) -> str:
    """Write a table for others as a new version of path, and give the version's name.

    Text cells can't be taken for formulas. The rows go to a folder of their own, are read back and
    compared in number and columns with what was written; only then a small file that names the version
    is replaced, in one step. So readers (read_published) see the old table or the new one, and after a
    failure the old one. Fewer than `least` rows are a failure. The last `keep` versions are kept, for
    those who read one.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    place = f"{path.rstrip('/')}/{version}"
    safe = df.select(*[safe_cell(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])
    seen = Observation()
    safe = safe.observe(seen, F.count("*").alias("rows"))
    safe.write.csv(place, header=True, quote='"', escape='"') if fmt == "csv" else safe.write.format(fmt).save(place)
    back = _version(spark, place, fmt)
    rows, found = seen.get["rows"], back.count()
    if found != rows or found < least or (found or fmt != "csv") and back.columns != df.columns:
        _delete(spark, place)
        raise ValueError(f"{found} rows of {back.columns} came back of {rows} of {df.columns}; at least {least} rows are wanted; {path} stays as it was")
    before = _manifest(spark, path)
    lines = [f"{version} {fmt}", *before][:keep]
    _replace(spark, f"{path.rstrip('/')}/{MANIFEST}", "\n".join(lines))
    for line in before[keep - 1 :]:
        _delete(spark, f"{path.rstrip('/')}/{line.split()[0]}")
    return version


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The version of a published table that is in force."""
    lines = _manifest(spark, path)
    if not lines:
        raise FileNotFoundError(f"nothing is published at {path}")
    version, fmt = lines[0].split()
    return _version(spark, f"{path.rstrip('/')}/{version}", fmt)


MANIFEST = "_versions"


def _version(spark: SparkSession, place: str, fmt: str) -> DataFrame:
    return spark.read.csv(place, header=True, quote='"', escape='"', multiLine=True) if fmt == "csv" else spark.read.format(fmt).load(place)


def _files(spark: SparkSession, path: str):
    """Hadoop's view of a path in any store: (file context, path)."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else p.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration()), p


def _manifest(spark: SparkSession, path: str) -> list[str]:
    """Versions and formats, the one in force first; none where nothing is published."""
    files, p = _files(spark, f"{path.rstrip('/')}/{MANIFEST}")
    if not files.util().exists(p):
        return []
    stream = files.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
    finally:
        stream.close()


def _replace(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside path and rename it over path."""
    jvm = spark._jvm
    files, draft = _files(spark, f"{path}-{uuid.uuid4().hex}")
    flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$CreateOpts"), 0)
    out = files.create(draft, flags, options)
    out.write(bytearray(text.encode()))
    out.close()
    how = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    how[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    files.rename(draft, jvm.org.apache.hadoop.fs.Path(path), how)


def _delete(spark: SparkSession, path: str) -> None:
    files, p = _files(spark, path)
    files.delete(p, True)


def read_run_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record): run records as JSON text, one a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("record"))


def read_roster(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(animal, axis, value): the column that names the animal, whatever its spelling; all others are axes."""
    df = read_measurements(spark, path, sep)
    plain = {c: "".join(ch for ch in c.lower() if ch.isalnum()) for c in df.columns}
    found = [c for name in ROSTER_NAMES for c in df.columns if plain[c] == name]
    if not found:
        raise ValueError(f"no column names the animal: {df.columns}")
    rest = [c for c in df.columns if c != found[0]]
    out = df.withColumnRenamed(found[0], "animal")
    return out.unpivot(["animal"], rest, "axis", "value").where(F.trim("value") != "") if rest else out.select("animal", F.lit(None).cast("string").alias("axis"), F.lit(None).cast("string").alias("value"))


def read_voxels(spark: SparkSession, path: str, section: str | None = None, z: tuple[int, int] | None = None) -> DataFrame:
    """Voxels stored by section and channel; the section prunes folders, the range of slices (from 1, inclusive) row groups."""
    df = spark.read.parquet(path)
    df = df.where(F.col("section_id") == section) if section is not None else df
    return df.where(F.col("z").between(*z)) if z else df


def write_voxels(df: DataFrame, path: str) -> None:
    df.repartition("section_id", "channel").sortWithinPartitions("z", "y", "x").write.mode("overwrite").partitionBy("section_id", "channel").parquet(path)


def collect_animals(tables: list[DataFrame]) -> DataFrame:
    """The distinct animals of all tables, by `Animal Name` or `AnimalName`."""
    out = None
    for t in tables:
        names = [c for c in ("Animal Name", "AnimalName") if c in t.columns]
        if names:
            one = t.select(F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in names]).alias("animal"))
            out = one if out is None else out.union(one)
    if out is None:
        raise ValueError("no table names animals")
    return out.where("animal IS NOT NULL").distinct()


def curves_to_rows(df: DataFrame, keys: list[str], curve: str) -> DataFrame:
    return df.select(*keys, F.posexplode(curve).alias("bin", "value"))


def rows_to_curves(df: DataFrame, keys: list[str]) -> DataFrame:
    """Curves of (keys, bin, value) rows, in the order of bins."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "value"))), lambda s: s["value"]).alias("curve"))
