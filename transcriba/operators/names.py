"""Names of files that never clash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def free_names(wanted: DataFrame, taken: DataFrame, name: str = "name", order: str = "ord") -> DataFrame:
    """Wanted (name, ord) with free: a name that neither taken (name) nor another row has.

    The first row of a name gets it as it is, if free, the next ones `stem_2.ext`, `stem_3.ext` and so on: the least numbers that are
    free. Gaps among taken numbers are filled in order. Rows are ranked by a window and free numbers by one more; none is tried in turn.
    """
    stem = F.regexp_extract(name, r"^(.*?)(\.[^./]*)?$", 1)
    ext = F.regexp_extract(name, r"^(.*?)(\.[^./]*)?$", 2)
    rows = wanted.withColumn("_rank", F.row_number().over(Window.partitionBy(name).orderBy(order)))
    groups = rows.groupBy(name).agg(F.max("_rank").cast("long").alias("_n"))
    base = groups.select(F.col(name).alias("_base"), stem.alias("_stem"), ext.alias("_ext"), "_n")
    # Every name that is used already or asked for by another base blocks a number of the bases it is a variant of.
    used = taken.select(F.col(name).alias("_used")).unionByName(wanted.select(F.col(name).alias("_used"))).distinct()
    number = F.regexp_extract("_used", r"_([1-9][0-9]{0,8})(\.[^./]*)?$", 1)
    variant = F.regexp_replace("_used", r"_[1-9][0-9]{0,8}(\.[^./]*)?$", "$1")
    blocks = used.where(number != "").select(variant.alias("_base"), number.cast("long").alias("_k")).where("_k >= 2")
    blocks = blocks.unionByName(taken.select(F.col(name).alias("_base"), F.lit(1).cast("long").alias("_k")).distinct())
    # Of n rows and b blocked numbers, the n least free numbers lie among 1 to n + b.
    held = blocks.groupBy("_base").agg(F.count("*").alias("_b"))
    slots = base.join(held, "_base", "left").withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n") + F.coalesce("_b", F.lit(0)))))
    open_slots = slots.join(blocks, ["_base", "_k"], "left_anti").withColumn("_rank", F.row_number().over(Window.partitionBy("_base").orderBy("_k")))
    chosen = F.when(F.col("_k") == 1, F.col("_base")).otherwise(F.concat("_stem", F.lit("_"), F.col("_k").cast("string"), "_ext"))
    found = open_slots.where(F.col("_rank") <= F.col("_n")).select(F.col("_base").alias(name), "_rank", chosen.alias("free"))
    return rows.join(found, [name, "_rank"]).drop("_rank")
