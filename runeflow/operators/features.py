"""Tag features and their compatibility (FE)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def values(tag: Column) -> Column:
    """FE1: values of a tag, in class order."""
    return F.split(tag, r"\.")


def components(tag: Column) -> Column:
    """FE1: values with composite ones, a/b, taken apart as well."""
    return F.array_distinct(F.concat(F.split(tag, r"\."), F.split(tag, "[./]")))


def compatible(a: Column, b: Column) -> Column:
    """FE2: equal, or one is a composite that holds the other; an undefined value fits itself only."""
    simple = lambda x: ~x.contains("/")
    return a.eqNullSafe(b) | F.coalesce((simple(a) & F.array_contains(F.split(b, "/"), a)) | (simple(b) & F.array_contains(F.split(a, "/"), b)), F.lit(False))


def parsed(tags: DataFrame, classes: dict[str, tuple[str, ...]]) -> DataFrame:
    """FE3: one column for each class, null where the tag has no value of it."""
    return tags.select("tag", *[F.get(F.filter(values(F.col("tag")), lambda v: v.isin(*vs)), F.lit(0)).alias(c) for c, vs in classes.items()])


def set_feature(cols: list[str], cls: str, value: str) -> list[Column]:
    """FE6: the value of one class replaced."""
    return [F.lit(value).alias(c) if c == cls else F.col(c) for c in cols]


def tag_string(cols: list[str]) -> Column:
    """FE7: defined values joined in class order."""
    return F.concat_ws(".", *cols)


def matching_tags(asked: DataFrame, tags: DataFrame, classes: list[str]) -> DataFrame:
    """FE8: for each asked tag the first by name that is compatible in every class it defines; ``set`` fits all.  Equal names come first.

    A theta join over the tag set, which is fixed and small.
    """
    b = tags.select(F.col("tag").alias("found"), *[F.col(c).alias(f"b_{c}") for c in classes])
    fit = F.lit(True)
    for c in classes:
        fit = fit & (F.col(c).isNull() | (F.col(c) == "set") | compatible(F.col(c), F.col(f"b_{c}")))
    hit = asked.join(F.broadcast(b), fit)
    w = Window.partitionBy("tag").orderBy(F.when(F.col("tag") == F.col("found"), 0).otherwise(1), "found")
    return hit.withColumn("n", F.row_number().over(w)).where("n = 1").select("tag", "found")
