"""Box counting and gliding-box lacunarity of objects of any size, in tiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The usual sides of boxes.
SIDES = (1, 2, 4, 8, 16, 32, 64)


def fractal(labels: DataFrame, by: list[str], sides: tuple[int, ...] = SIDES, least: int = 8, reliable: float = 0.9, size: int = 256) -> DataFrame:
    """(by, label, dimension, r2, reliable, lacunarity, lacunarity_sd) of positive labels (by, y, x, label).

    dimension: minus the slope of log boxes against log side, of boxes laid from the object's first row and
    column, with sides up to the object's longer one; it needs three of them. Lacunarity of a side: variance
    over squared mean, plus 1, of the pixels in a box that glides over the object with a border of a quarter
    of its longer side; reported are mean and sample deviation (0 of one) over the sides that fit. Objects
    less than `least` high or wide are left out. reliable: r2 is that much at least.
    """
    own = labels.where("label > 0").select(*by, "label", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).distinct()
    box = own.groupBy(*by, "label").agg(*[f(c).alias(f"{c}{i}") for c in "yx" for i, f in enumerate((F.min, F.max))])
    box = box.withColumns({"h": F.col("y1") - F.col("y0") + 1, "w": F.col("x1") - F.col("x0") + 1}).where((F.col("h") >= least) & (F.col("w") >= least))
    box = box.withColumns({"side": F.greatest("h", "w"), "pad": F.ceil(F.greatest("h", "w") / 4.0)})
    px = own.join(box.hint("merge"), [*by, "label"])

    boxes = px.select(*by, "label", "side", (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), F.explode(F.array(*[F.lit(r) for r in sides])).alias("r")).where("r <= side")
    count = boxes.groupBy(*by, "label", "r").agg(F.countDistinct(F.floor(F.col("y") / F.col("r")), F.floor(F.col("x") / F.col("r"))).alias("n"))
    line = count.groupBy(*by, "label").agg(F.count("*").alias("k"), (-F.regr_slope(F.log("n"), F.log("r"))).alias("dimension"), F.regr_r2(F.log("n"), F.log("r")).alias("r2")).where("k >= 3").drop("k")

    # a pixel counts in every box whose first corner is less than a side before it
    most = max(sides)
    corner = lambda c: F.explode(F.sequence(F.floor((F.col(c) - most + 1) / size), F.floor(F.col(c) / size)))
    spread = px.withColumn("ty", corner("y")).withColumn("tx", corner("x"))
    schema = T.StructType([*[labels.schema[c] for c in by], labels.schema["label"], T.StructField("r", T.LongType()), T.StructField("s1", T.DoubleType()), T.StructField("s2", T.DoubleType())])

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        top, left, pad = int(first["ty"]) * size, int(first["tx"]) * size, int(first["pad"])
        mask = np.zeros((size + most, size + most), np.int64)
        mask[pdf["y"].to_numpy() - top, pdf["x"].to_numpy() - left] = 1
        sums = np.zeros((size + most + 1, size + most + 1), np.int64)
        np.cumsum(np.cumsum(mask, 0), 1, out=sums[1:, 1:])
        rows = []
        for r in sides:
            y = np.arange(max(0, first["y0"] - pad - top), min(size, first["y1"] + pad - r + 2 - top))
            x = np.arange(max(0, first["x0"] - pad - left), min(size, first["x1"] + pad - r + 2 - left))
            if len(y) and len(x):
                y, x = y[:, None], x[None]
                mass = sums[y + r, x + r] - sums[y, x + r] - sums[y + r, x] + sums[y, x]
                rows.append((*first[by], first["label"], r, float(mass.sum()), float((mass * mass).sum())))
        return pd.DataFrame(rows, columns=schema.names)

    mass = spread.groupBy(*by, "label", "ty", "tx").applyInPandas(tile, schema).groupBy(*by, "label", "r").agg(F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    rows, columns = (F.col(c) + 2 * F.col("pad") - F.col("r") + 1 for c in ("h", "w"))
    lac = mass.join(box.select(*by, "label", "h", "w", "pad").hint("merge"), [*by, "label"]).where((rows > 0) & (columns > 0) & (F.col("s1") > 0))
    n, mean = rows * columns, F.col("s1") / (rows * columns)
    lac = lac.withColumn("l", F.greatest(F.lit(0.0), F.col("s2") / n - mean * mean) / (mean * mean) + 1)
    lac = lac.groupBy(*by, "label").agg(F.avg("l").alias("lacunarity"), F.coalesce(F.stddev_samp("l"), F.lit(0.0)).alias("lacunarity_sd"))
    return line.join(lac.hint("merge"), [*by, "label"]).select(*by, "label", "dimension", "r2", (F.col("r2") >= reliable).alias("reliable"), "lacunarity", "lacunarity_sd")
