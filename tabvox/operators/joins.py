"""Joins of the master tables with their dimensions, and checks between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def condition_join(df: DataFrame, conditions: DataFrame, animal: str = "animal", detected: str | None = None) -> DataFrame:
    """Add condition (axis values in axis order joined by _) and, with two axes or more, condition_<axis>.

    conditions: (animal, axis, value). The saved value wins if it isn't blank, else the column
    `detected`. The number of axes is read from the table.
    """
    clean = conditions.where(F.trim("value") != "").groupBy("animal", "axis").agg(F.min(F.trim("value")).alias("value"))
    axes = [r[0] for r in clean.select("axis").distinct().orderBy("axis").collect()]
    wide = clean.groupBy("animal").pivot("axis", axes).agg(F.min("value")) if axes else clean.select("animal").distinct()
    wide = wide.select(F.col("animal").alias("__animal"), *[F.col(a).alias(f"condition_{a}") for a in axes])
    out = df.join(wide, df[animal] == wide["__animal"], "left").drop("__animal")
    joined = F.nullif(F.concat_ws("_", *[F.col(f"condition_{a}") for a in axes]), F.lit("")) if axes else F.lit(None).cast("string")
    out = out.withColumn("condition", F.coalesce(joined, F.col(detected) if detected else F.lit(None).cast("string")))
    return out if len(axes) > 1 else out.drop(*[f"condition_{a}" for a in axes])


def remap_axis(df: DataFrame, conditions: DataFrame, axis: str, animal: str = "animal", parent: str = "parent") -> DataFrame:
    """Replace condition by one axis' value: of the parent, else of the animal itself, else as it was."""
    one = conditions.where(F.col("axis") == axis).groupBy("animal").agg(F.min("value").alias("v"))
    out = df.join(one.withColumnsRenamed({"animal": "__p", "v": "__pv"}), F.col(parent) == F.col("__p"), "left")
    out = out.join(one.withColumnsRenamed({"animal": "__a", "v": "__av"}), F.col(animal) == F.col("__a"), "left")
    return out.withColumn("condition", F.coalesce("__pv", "__av", "condition")).drop("__p", "__pv", "__a", "__av")


def channel_merge(long: DataFrame, key: str, channels: list[str], value: str) -> DataFrame:
    """One row for each key with <channel>_<value> columns; a channel that lacks the key gives null."""
    return long.groupBy(key).pivot("channel", channels).agg(F.min(value)).select(key, *[F.col(c).alias(f"{c}_{value}") for c in channels])


def full_merge(first: DataFrame, later: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join in which later's values win over first's columns of the same name."""
    both = [c for c in later.columns if c in first.columns and c not in keys]
    a, b = first.withColumnsRenamed({c: f"__{c}" for c in both}), later
    out = a.join(b, keys, "full")
    return out.withColumns({c: F.coalesce(c, f"__{c}") for c in both}).drop(*[f"__{c}" for c in both])


def cascade(df: DataFrame, key: str, table: DataFrame, normalise) -> DataFrame:
    """Look key up in (key, rank, value): the best rank wins; else with trailing digits removed; else the key itself."""
    best = table.groupBy(normalise(F.col("key")).alias("__k")).agg(F.min_by("value", F.struct("rank", "value")).alias("__v"))
    short = best.withColumnsRenamed({"__k": "__k2", "__v": "__v2"})
    out = df.withColumn("__n", normalise(F.col(key))).withColumn("__s", F.regexp_replace("__n", r"\d+$", ""))
    out = out.join(best, F.col("__n") == F.col("__k"), "left").join(short, F.col("__s") == F.col("__k2"), "left")
    return out.withColumn("resolved", F.coalesce("__v", "__v2", key)).drop("__n", "__s", "__k", "__v", "__k2", "__v2")


def marker_lookup(df: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """(key, id, hits) by the lowest tier of (tier, name, id) that matches: 1 id, 2 synonym, both exact, 3 normalised.

    Several ids of that tier stay ambiguous (null).
    """
    norm = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    asked = df.select(F.col(key).alias("__q")).distinct().select("__q", F.explode(F.array(F.concat(F.lit("="), "__q"), F.concat(F.lit("~"), norm(F.col("__q"))))).alias("k"))
    named = table.select("tier", "id", F.when(F.col("tier") == 3, F.concat(F.lit("~"), norm(F.col("name")))).otherwise(F.concat(F.lit("="), "name")).alias("k"))
    best = asked.join(named.hint("merge"), "k").groupBy("__q", "tier").agg(F.countDistinct("id").alias("hits"), F.min("id").alias("id")).groupBy("__q").agg(F.min_by(F.struct("id", "hits"), "tier").alias("b"))
    return df.join(best, F.col(key) == F.col("__q"), "left").select(*[F.col(c) for c in df.columns], F.when(F.col("b.hits") == 1, F.col("b.id")).alias("id"), F.coalesce("b.hits", F.lit(0)).alias("hits"))


def roster_check(data: DataFrame, roster: DataFrame, animal: str = "animal", value: str = "value") -> DataFrame:
    """(animal, problem): missing in the roster, missing in the data, repeated in it, or named with two values."""
    d, r = data.select(animal).distinct(), roster.select(animal).distinct()
    counts = roster.groupBy(animal).agg(F.count("*").alias("n"), F.countDistinct(value).alias("values"))
    return (
        d.join(r, animal, "left_anti").withColumn("problem", F.lit("not in roster"))
        .union(r.join(d, animal, "left_anti").withColumn("problem", F.lit("not in data")))
        .union(counts.where("n > 1 AND values <= 1").select(animal, F.lit("repeated").alias("problem")))
        .union(counts.where("values > 1").select(animal, F.lit("conflict").alias("problem")))
    )


def near_names(df: DataFrame, name: str, most: int = 2) -> DataFrame:
    """Pairs a < b of distinct names whose stripped lower-case forms lie within an edit distance.

    Names within distance k share, of k + 1 pieces one of which stays unedited, at least one; the
    join is on the pieces' text shifted by up to k places, not on all pairs.
    """
    t = F.regexp_replace(F.lower(F.col(name)), r"[^a-z0-9]", "")
    tokens = df.select(F.col(name).alias("name"), t.alias("t")).where(F.length("t") > most).distinct()
    size = F.length("t")
    cut = lambda i: F.floor(size * i / (most + 1)).cast("int")
    pieces = F.array(*[F.struct(F.lit(i).alias("i"), cut(i).alias("at"), F.col("t").substr(cut(i) + 1, cut(i + 1) - cut(i)).alias("p")) for i in range(most + 1)])
    left = tokens.select(F.col("name").alias("x"), F.col("t").alias("tx"), size.alias("nx"), F.explode(pieces).alias("q")).select("x", "tx", "nx", F.col("q.at").alias("at"), F.col("q.p").alias("p"), (F.length("q.p")).alias("len"))
    # all substrings of the piece lengths that occur for names of about this size
    lengths = F.array_distinct(F.flatten(F.transform(F.sequence(size - most, size + most), lambda n: F.array(*[F.floor(n * (i + 1) / (most + 1)).cast("int") - F.floor(n * i / (most + 1)).cast("int") for i in range(most + 1)]))))
    right = tokens.select(F.col("name").alias("y"), F.col("t").alias("ty"), F.explode(F.filter(lengths, lambda k: k > 0)).alias("len"))
    right = right.select("y", "ty", "len", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("ty") - F.col("len")))).alias("pos")).select("y", "ty", "len", "pos", F.col("ty").substr(F.col("pos") + 1, F.col("len")).alias("p"))
    near = left.join(right.hint("merge"), ["p", "len"]).where((F.col("x") < F.col("y")) & (F.abs(F.col("pos") - F.col("at")) <= most))
    reverse = left.withColumnsRenamed({"x": "y", "tx": "ty", "nx": "ny"}).join(right.withColumnsRenamed({"y": "x", "ty": "tx"}).hint("merge"), ["p", "len"]).where((F.col("x") < F.col("y")) & (F.abs(F.col("pos") - F.col("at")) <= most))
    pairs = near.select("x", "y", "tx", "ty").union(reverse.select("x", "y", "tx", "ty")).distinct()
    return pairs.withColumn("distance", F.levenshtein("tx", "ty")).where(F.col("distance") <= most).select(F.col("x").alias("a"), F.col("y").alias("b"), "distance")


def complete_cases(df: DataFrame, by: list[str], subject: str, condition: str) -> DataFrame:
    """Rows of subjects that are present in every condition of their group."""
    all_ = df.groupBy(*by).agg(F.countDistinct(condition).alias("k"))
    own = df.groupBy(*by, subject).agg(F.countDistinct(condition).alias("k"))
    return df.join(own.join(all_, [*by, "k"]).select(*by, subject), [*by, subject], "left_semi")


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], metrics: list[str], least: float = 1e-9) -> DataFrame:
    """(keys, status, metric, before, after): rows added and removed, and shifts of metrics over `least`."""
    def marked(df, name):
        return df.select(*keys, F.lit(True).alias(f"in_{name}"), *[F.col(m).alias(f"{name}_{m}") for m in metrics])

    both = marked(old, "old").join(marked(new, "new"), keys, "full")
    rows = F.when(F.col("in_new").isNull(), F.array(F.struct(F.lit("removed").alias("status"), F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("before"), F.lit(None).cast("double").alias("after"))))
    rows = rows.when(F.col("in_old").isNull(), F.array(F.struct(F.lit("added").alias("status"), F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("before"), F.lit(None).cast("double").alias("after"))))
    shifts = F.array(*[F.struct(F.lit("shift").alias("status"), F.lit(m).alias("metric"), F.col(f"old_{m}").cast("double").alias("before"), F.col(f"new_{m}").cast("double").alias("after")) for m in metrics])
    moved = F.filter(shifts, lambda s: ~F.coalesce(F.abs(s["before"] - s["after"]) <= least, s["before"].isNull() & s["after"].isNull()))
    return both.select(*keys, F.explode(rows.otherwise(moved)).alias("r")).select(*keys, "r.*")


def append_tables(first: DataFrame, more: DataFrame, run: str = "run_id") -> DataFrame:
    """Union of tables with equal headers but for a run id, which is blank where it lacks."""
    if set(first.columns) - {run} != set(more.columns) - {run}:
        raise ValueError(f"headers differ: {sorted(set(first.columns) ^ set(more.columns))}")
    return first.unionByName(more, allowMissingColumns=True)


def merge_columns(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """existing with new's columns added or overwritten where new has a value; manual columns stay."""
    both = [c for c in new.columns if c in existing.columns and c not in keys]
    out = existing.withColumnsRenamed({c: f"__{c}" for c in both}).join(new, keys, "left")
    return out.withColumns({c: F.coalesce(c, f"__{c}") for c in both}).drop(*[f"__{c}" for c in both])


def extend_rows(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New rows after the old; columns that either lacks are null."""
    return existing.unionByName(new, allowMissingColumns=True)


def pending(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose output doesn't exist yet."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def mutual_nearest(pairs: DataFrame, a: str, b: str, distance: str) -> DataFrame:
    """Pairs in which each is the other's nearest; ties go to the smaller id."""
    wa, wb = W.partitionBy(a).orderBy(distance, b), W.partitionBy(b).orderBy(distance, a)
    return pairs.withColumns({"ra": F.row_number().over(wa), "rb": F.row_number().over(wb)}).where("ra = 1 AND rb = 1").drop("ra", "rb")


def naming_drift(df: DataFrame, name: str, most: int = 2) -> DataFrame:
    """(name, usual): names with a near namesake that more rows bear (or as many, and first by name); usual is the most frequent one."""
    counts = df.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n"))
    pairs = near_names(counts.select("name"), "name", most)
    both = pairs.select(F.col("a").alias("name"), F.col("b").alias("usual")).union(pairs.select("b", "a"))
    j = both.join(counts, "name").join(counts.select(F.col("name").alias("usual"), F.col("n").alias("m")), "usual")
    j = j.where((F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("usual") < F.col("name"))))
    return j.groupBy("name").agg(F.min_by("usual", F.struct(-F.col("m"), F.col("usual"))).alias("usual"))
