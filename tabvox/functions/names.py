"""Names of images, animals, hemispheres, conditions and metrics, parsed with built-in string functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabvox.functions.lineage import cut
from tabvox.functions.scalar import blank_to_null


def parse_image_name(name: Column) -> Column:
    """struct(experiment, animal, hemisphere, region, condition) of `Exp-Animal_LH_Region[_Cond]`.

    What follows ` - ` replaces the name; the hemisphere is the last of LH and RH among the last three
    tokens; a name of another form is the animal as a whole.
    """
    base = F.when(F.contains(name, F.lit(" - ")), F.substring_index(name, " - ", -1)).otherwise(name)
    base = F.regexp_replace(base, r"\.[A-Za-z]{2,5}$", "")
    t = F.split(base, "_")
    n = F.size(t)
    # try_element_at gives null outside the array
    at = F.coalesce(*[F.when(F.upper(F.try_element_at(t, F.lit(-k))).isin("LH", "RH") & (n > k), F.lit(k)) for k in (1, 2, 3)])
    rest = F.array_join(F.slice(t, 1, F.greatest(F.lit(0), n - at)), "_")
    ok = at.isNotNull()
    return F.struct(
        F.when(ok & F.contains(rest, F.lit("-")), F.substring_index(rest, "-", 1)).alias("experiment"),
        F.when(ok, F.when(F.contains(rest, F.lit("-")), F.regexp_replace(rest, "^[^-]*-", "")).otherwise(rest)).otherwise(base).alias("animal"),
        F.when(ok, F.upper(F.try_element_at(t, n - at + 1))).alias("hemisphere"),
        F.when(at >= 2, F.try_element_at(t, n - at + 2)).alias("region"),
        F.when(at >= 3, F.try_element_at(t, n - at + 3)).alias("condition"),
    )


def detect_condition(animal: Column) -> Column:
    """The name without its first run of digits between letters, else without its last digits; null if nothing is left."""
    inner = F.regexp_replace(animal, r"^(.*?[A-Za-z])\d+([A-Za-z].*)$", "$1$2")
    return F.nullif(F.trim(F.when(inner != animal, inner).otherwise(F.regexp_replace(animal, r"[\s_-]*\d+$", ""))), F.lit(""))


def hemisphere_from_roi(roi: Column) -> Column:
    token = F.upper(F.regexp_extract(roi, r"(?i)(?:^|[^A-Za-z])(LH|RH)(?:[^A-Za-z]|$)", 1))
    prefix = F.upper(F.regexp_extract(roi, r"(?i)^(LH|RH)", 1))
    return F.coalesce(F.nullif(token, F.lit("")), F.nullif(prefix, F.lit("")))


def hemisphere_alias(name: Column, aliases: dict[str, str]) -> Column:
    """LH or RH by the first token that is an alias; null if none is."""
    m = F.create_map(*[F.lit(x) for k, v in sorted(aliases.items()) for x in (k.lower(), v)])
    return F.try_element_at(F.array_compact(F.transform(F.split(F.lower(name), r"[\s_.\-]+"), lambda t: F.try_element_at(m, t))), F.lit(1))


def section_key(scn: Column, roi: Column, region: Column) -> Column:
    return F.coalesce(blank_to_null(scn), blank_to_null(roi), blank_to_null(region))


def animal_unit(df: DataFrame, name: str) -> DataFrame:
    """Add unit: the name without -LH, -RH, -SCN*, -Unknown*, or another letters-only ending that two names or more have in common."""
    known = F.regexp_replace(F.col(name), r"-(LH|RH|SCN.*|Unknown.*)$", "")
    head, tail = F.regexp_extract(F.col(name), r"^(.*)-([A-Za-z]+)$", 1), F.regexp_extract(F.col(name), r"^(.*)-([A-Za-z]+)$", 2)
    shared = df.select(tail.alias("tail"), head.alias("head")).where("tail <> ''").groupBy("tail").agg(F.countDistinct("head").alias("__k"))
    out = df.withColumns({"__tail": tail, "__head": head}).join(shared.withColumnRenamed("tail", "__t"), F.col("__tail") == F.col("__t"), "left")
    return out.withColumn("unit", F.when(known != F.col(name), known).when(F.col("__k") >= 2, F.col("__head")).otherwise(F.col(name))).drop("__tail", "__head", "__t", "__k")


def partner_from_column(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"_(?:VolOverlap|BBColoc|CPCColoc|CPCContains|VolContains)\d*_(.+)$", 1), F.lit(""))


def metric_label(name: Column, rules: list[tuple[str, str]]) -> Column:
    """The first rule (pattern, replacement) that matches names the metric; else the name as it is."""
    out = None
    for pattern, label in rules:
        hit, made = name.rlike(pattern), F.regexp_replace(name, pattern, label)
        out = F.when(hit, made) if out is None else out.when(hit, made)
    return name if out is None else out.otherwise(name)


def infer_identity(df: DataFrame, name: str, least: int = 6) -> DataFrame:
    """(name, animal, condition) by how often tokens differ at each position of the names.

    The animal is at the position of most distinct tokens, if they are 60 % of the names at least; the
    condition at another position of fewest, from two to half of the names. Fewer than `least` names: nulls.
    """
    names = df.select(F.col(name).alias("name")).where("name IS NOT NULL").distinct()
    t = F.split("name", r"[ _.\-]+")
    # a number for each position of a token
    stats = [(r[0], r[1]) for r in names.select("name", F.posexplode(t).alias("pos", "token")).groupBy("pos").agg(F.countDistinct("token")).collect()]
    n, apos, cpos = names.count(), None, None
    if n >= least and stats:
        at, d = min(stats, key=lambda s: (-s[1], s[0]))
        apos = at if d >= 0.6 * n else None
        few = [s for s in stats if 2 <= s[1] <= n / 2 and s[0] != apos]
        cpos = min(few, key=lambda s: (s[1], s[0]))[0] if few else None
    get = lambda k: F.lit(None).cast("string") if k is None else F.get(t, F.lit(k))
    return names.select("name", get(apos).alias("animal"), get(cpos).alias("condition"))


def group_label(axes: list[Column]) -> Column:
    return F.concat_ws("_", *[blank_to_null(a) for a in axes])


def safe_cell(c: Column) -> Column:
    """A cell that a spreadsheet doesn't take for a formula."""
    return F.when(c.rlike(r"^[=+@\-]"), F.concat(F.lit("'"), c)).otherwise(c)


def flatten_json(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path, value) of all leaves of JSON texts, at any depth: keys joined by dots, array places as [i].

    Empty objects and arrays are leaves of their own, {} and []. A text that isn't JSON is a leaf itself,
    with an empty path, and so is a null. Strings are kept whatever they begin with; numbers come in their
    plain form. Each round opens one level of what is still nested, until nothing is.
    """
    text = df.select(F.col(f"`{key}`").alias("key_"), F.col(f"`{column}`").cast("string").alias("text_")).withColumn("v_", F.try_parse_json("text_"))
    done = text.where("v_ IS NULL").select("key_", F.lit("").alias("path_"), F.col("text_").alias("value"))
    level = text.where("v_ IS NOT NULL").select("key_", F.lit("").alias("path_"), "v_")
    nested = "substr(schema_of_variant(v_), 1, 5) IN ('OBJEC', 'ARRAY') AND to_json(v_) NOT IN ('{}', '[]')"
    while True:
        leaf = F.when(F.expr("schema_of_variant(v_) = 'VOID'"), None).when(F.expr("substr(schema_of_variant(v_), 1, 5) IN ('OBJEC', 'ARRAY')"), F.to_json("v_")).otherwise(F.variant_get("v_", "$", "string"))
        done = done.unionByName(level.where(f"NOT ({nested})").select("key_", "path_", leaf.alias("value")))
        step = "CASE WHEN key IS NULL THEN concat(path_, '[', pos, ']') WHEN path_ = '' THEN key ELSE concat(path_, '.', key) END"
        level = cut(df.sparkSession.sql(f"SELECT key_, {step} AS path_, value AS v_ FROM {{level}}, LATERAL variant_explode(v_) AS t(pos, key, value)", level=level.where(nested)))
        if level.isEmpty():
            return done.select(F.col("key_").alias(key), F.col("path_").alias("path"), "value")


def curve_normalise(curve: Column, how: str) -> Column:
    """A curve by min-max, by its mean or as z-scores; constant curves give zeros (by mean: unchanged if 0)."""
    n = F.size(curve)
    mean = F.aggregate(curve, F.lit(0.0), lambda a, x: a + x) / n
    if how == "minmax":
        low, high = F.array_min(curve), F.array_max(curve)
        return F.transform(curve, lambda x: F.when(high > low, (x - low) / (high - low)).otherwise(0.0))
    if how == "mean":
        return F.transform(curve, lambda x: F.when(mean != 0, x / mean).otherwise(x))
    sd = F.sqrt(F.aggregate(curve, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)
    return F.transform(curve, lambda x: F.when(sd > 0, (x - mean) / sd).otherwise(0.0))


def date_gaps(df: DataFrame, by: list[str], time: str) -> DataFrame:
    """Add days: whole days since the row before in the group."""
    return df.withColumn("days", F.datediff(time, F.lag(time).over(W.partitionBy(*by).orderBy(time))))


def normal_name(c: Column) -> Column:
    """Trimmed, lower case, inner blanks as one; null counts as empty."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"\s+", " ")


def region_selected(region: Column, include: list[str], exclude: list[str]) -> Column:
    """Named in include (an empty list names all) and not in exclude; spelling of case and blanks doesn't count."""
    norm = lambda names: [" ".join(n.lower().split()) for n in names]
    name = normal_name(region)
    wanted = name.isin(*norm(include)) if include else F.lit(True)
    return wanted & ~name.isin(*norm(exclude)) if exclude else wanted


def grammar(name: Column, rules: dict[str, list[tuple[str, float]]], vocabulary: dict[str, list[str]] | None = None) -> Column:
    """struct of (value, confidence) for each field, from its rules (pattern with one group, confidence).

    The surest rule that matches wins, the first one among equals. Values outside a field's vocabulary,
    where it has one, count as no match; case doesn't matter there and the vocabulary's spelling is returned.
    """
    fields = []
    for field, options in rules.items():
        known = (vocabulary or {}).get(field)
        spell = F.create_map(*[F.lit(x) for v in known for x in (v.lower(), v)]) if known else None
        tried = []
        for pattern, sure in sorted(options, key=lambda o: -o[1]):
            hit = F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))
            hit = F.try_element_at(spell, F.lower(hit)) if spell is not None else hit
            tried.append(F.when(hit.isNotNull(), F.struct(hit.alias("value"), F.lit(float(sure)).alias("confidence"))))
        fields.append(F.coalesce(*tried).alias(field))
    return F.struct(*fields)


def search_rank(query: str, id: Column, name: Column) -> Column:
    """0 the id itself, 1 the name itself, 2 a beginning of the name, 3 a beginning of one of its words, 4 within it, else null."""
    q, n = query.strip().lower(), F.lower(name)
    return F.when(F.lower(id) == q, 0).when(n == q, 1).when(n.startswith(q), 2).when(F.contains(n, F.lit(f" {q}")), 3).when(F.contains(n, F.lit(q)), 4)


def curve_measures(curve: Column, threshold_pct: float = 50.0) -> Column:
    """struct(core_edge, peak, ring, uniformity) of an array of doubles, missing values left out.

    core_edge: mean of the first third over that of the last, null unless that is positive; peak: place of
    the first largest value as a share of the length; ring: share of places that reach threshold_pct of
    the largest value; uniformity: 1 - sd / mean, at least 0. Each is null where it isn't defined.
    """
    n = F.size(curve)
    there = lambda a: F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x))
    mean = lambda a: F.when(F.size(there(a)) > 0, F.aggregate(there(a), F.lit(0.0), lambda s, x: s + x) / F.size(there(a)))
    third, two = F.floor(n / 3).cast("int"), F.floor(2 * n / 3).cast("int")
    inner, outer = mean(F.slice(curve, F.lit(1), third)), mean(F.slice(curve, two + 1, n - two))
    top, m = F.array_max(there(curve)), mean(curve)
    variance = F.aggregate(there(curve), F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(there(curve))
    return F.struct(
        F.when(outer > 0, inner / outer).alias("core_edge"),
        F.when(top.isNotNull(), (F.array_position(curve, top) - 0.5) / n).alias("peak"),
        F.when(top > 0, F.size(F.filter(curve, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= threshold_pct / 100 * top))) / n).alias("ring"),
        F.when(m > 0, F.greatest(F.lit(0.0), 1 - F.sqrt(variance) / m)).alias("uniformity"),
    )
