"""How far codes drift between two builds, and how well labels agree with the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions import codes, names


def load_pairs(map_x: DataFrame, classes_x: DataFrame, map_y: DataFrame, classes_y: DataFrame) -> DataFrame:
    """(original, x_hi, x_lo, y_hi, y_lo) of classes with a code in both builds. Mappings:
    (original, obfuscated); classes: (fqcn, hi, lo). Removed and generated ones are out."""
    marked = F.lit(names.REMOVED_MARK)
    x = map_x.select("original", F.col("obfuscated").alias("ox"))
    y = map_y.select("original", F.col("obfuscated").alias("oy"))
    both = x.join(y, "original").where(~F.contains("ox", marked) & ~F.contains("oy", marked) & ~names.is_synthetic(F.col("original")))
    cx = classes_x.where("hi is not null").select(F.col("fqcn").alias("ox"), F.col("hi").alias("x_hi"), F.col("lo").alias("x_lo"))
    cy = classes_y.where("hi is not null").select(F.col("fqcn").alias("oy"), F.col("hi").alias("y_hi"), F.col("lo").alias("y_lo"))
    return both.join(cx, "ox").join(cy, "oy").select("original", "x_hi", "x_lo", "y_hi", "y_lo")


def drift(pairs: DataFrame) -> DataFrame:
    """Pairs with their distance and whether the class is a library's."""
    d = codes.hamming(F.col("x_hi"), F.col("x_lo"), F.col("y_hi"), F.col("y_lo"))
    return pairs.select("original", d.alias("distance"), names.is_library(F.col("original")).alias("library"))


def histogram(drifted: DataFrame) -> DataFrame:
    """(distance, n_all, n_library, n_app)."""
    return drifted.groupBy("distance").agg(F.count("*").alias("n_all"), F.count_if("library").alias("n_library"), F.count_if(~F.col("library")).alias("n_app"))


def grand_histogram(drifted: DataFrame) -> DataFrame:
    """(pair, distance, n) of drifted pairs with a column ``pair`` that names their builds:
    a histogram of each pair of builds, and one of all together (pair null)."""
    counts = drifted.groupBy("pair", "distance").agg(F.count("*").alias("n"))
    return counts.unionByName(counts.groupBy("distance").agg(F.sum("n").alias("n")).withColumn("pair", F.lit(None).cast(drifted.schema["pair"].dataType)))


def cumulative(hist: DataFrame) -> DataFrame:
    """The histogram with the share of pairs up to each distance, and a bar. The table has
    at most 129 rows, so its one ordered partition is small."""
    upto = Window.orderBy("distance").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    bar = F.repeat(F.lit("#"), F.least(F.lit(40), F.floor(40 * F.col("n_all") / F.max("n_all").over(whole))).cast("int"))
    return hist.withColumns({"share": F.sum("n_all").over(upto) / F.sum("n_all").over(whole), "bar": bar})


def percentiles(drifted: DataFrame, at: list[float], where: Column | None = None) -> DataFrame:
    """(p, distance): the least distance that at least the share p does not pass; null
    without pairs, 0 for p = 0."""
    rows = drifted if where is None else drifted.where(where)
    found = [F.expr(f"cast(percentile_disc({float(p)}D) within group (order by distance) as int)").alias(f"p{k}") for k, p in enumerate(at)]
    out = rows.agg(F.count("*").alias("n"), *found)
    each = [F.struct(F.lit(float(p)).alias("p"), F.when(F.col("n") > 0, F.lit(0) if p == 0 else F.col(f"p{k}")).alias("distance")) for k, p in enumerate(at)]
    return out.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def regime(r95: Column) -> Column:
    """How narrow the drift is that 95 of 100 pairs keep within."""
    return F.when(r95.isNull(), None).when(r95 <= 6, "tight").when(r95 <= 14, "moderate").otherwise("wide")


def evaluate(detections: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: tested, tp, fp, fn, precision, recall, f1, and true hits by tier.
    detections: (qid, found, tier), found null without a hit; truth: (qid, original),
    original null for classes of no known library. A wrong hit is only a false positive."""
    rows = detections.join(truth, "qid", "left")
    right = F.col("found").isNotNull() & F.col("original").eqNullSafe(F.col("found"))
    tiers = [F.count_if(right & (F.col("tier") == k)).alias(f"tier{k}") for k in (1, 2, 3)]
    out = rows.agg(F.count_if(F.col("original").isNotNull()).alias("tested"), F.count_if(right).alias("tp"), F.count_if(F.col("found").isNotNull() & ~right).alias("fp"), F.count_if(F.col("found").isNull() & F.col("original").isNotNull()).alias("fn"), *tiers)

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    tp = F.col("tp")
    out = out.withColumns({"precision": share(tp, tp + F.col("fp")), "recall": share(tp, tp + F.col("fn"))})
    return out.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def by_root(detections: DataFrame, truth: DataFrame, limit: int = 12) -> DataFrame:
    """(root, detected, present) of the library roots with most true hits."""
    rows = detections.join(truth.where("original is not null"), "qid")
    root = names.library_root(F.col("original")).alias("root")
    out = rows.groupBy(root).agg(F.count_if(F.col("found") == F.col("original")).alias("detected"), F.count("*").alias("present"))
    return out.where("detected > 0").orderBy(F.desc("detected"), "root").limit(limit)


def recovered(detections: DataFrame, truth: DataFrame, limit: int = 8) -> DataFrame:
    """Some true hits by radius or by string, least qid first."""
    rows = detections.join(truth, "qid").where((F.col("found") == F.col("original")) & F.col("tier").isin(2, 3))
    return rows.orderBy("qid").limit(limit)
