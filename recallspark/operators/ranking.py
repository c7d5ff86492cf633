"""Top rows and token budgets, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that a group is split into before its top rows are taken.
SALT = 32


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int, out: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group with their rank from 1.

    Each of SALT parts of a group is cut to n rows first, so the last step sees at most SALT * n rows of a group however large that is.
    """
    # the id alone where there is one, so that wide columns nobody asked for are not read for their hash
    names = ["id"] if "id" in df.columns else [c for c in df.columns if not _nested(df, c)]
    salted = df.withColumn("__part", F.pmod(F.xxhash64(*names), F.lit(SALT)))
    near = salted.withColumn("__r", F.row_number().over(Window.partitionBy(*group, "__part").orderBy(*order))).filter(F.col("__r") <= n)
    far = near.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) if group else F.row_number().over(Window.orderBy(*order)))
    return far.filter(F.col(out) <= n).drop("__part", "__r")


def _nested(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() in ("map", "variant")


def budget_prefix(df: DataFrame, group: list[str], order: list[Column], tokens: str, budget, out: str = "used") -> DataFrame:
    """Rows of each group, in order, until the first that would exceed the budget; ``out`` is the running sum.

    The running sum never falls, so a prefix is exactly the rows with a sum within the budget.
    """
    window = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(tokens).over(window)).filter(F.col(out) <= budget)


def running(df: DataFrame, group: str, key: str, tie: list[str], width: int, **sums: Column) -> DataFrame:
    """``df`` with the running sum of each of ``sums`` within each group, in order of a whole number ``key`` and ties, up to and with the row.

    No window spans a group. Stretches of ``width`` key values are summed by themselves and moved by the stretches before them; stretches are
    added up first, and 1,024 of them make up a far stretch.
    """
    rows = df.withColumns({f"__v_{n}": c for n, c in sums.items()})
    rows = rows.withColumn("__s", F.floor(F.coalesce(F.col(key), F.lit(0)) / width)).withColumn("__f", F.floor(F.col("__s") / 1024))
    before = (Window.unboundedPreceding, -1)
    per = rows.groupBy(group, "__f", "__s").agg(*[F.sum(f"__v_{n}").alias(f"__c_{n}") for n in sums])
    far = per.groupBy(group, "__f").agg(*[F.sum(f"__c_{n}").alias(f"__c_{n}") for n in sums])
    of_group = Window.partitionBy(group).orderBy("__f").rowsBetween(*before)
    of_far = Window.partitionBy(group, "__f").orderBy("__s").rowsBetween(*before)
    of_stretch = Window.partitionBy(group, "__s").orderBy(key, *tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    far = far.select(group, "__f", *[F.coalesce(F.sum(f"__c_{n}").over(of_group), F.lit(0)).alias(f"__g_{n}") for n in sums])
    near = per.select(group, "__f", "__s", *[F.coalesce(F.sum(f"__c_{n}").over(of_far), F.lit(0)).alias(f"__o_{n}") for n in sums])
    offsets = near.join(far, [group, "__f"]).select(group, "__s", *[(F.col(f"__o_{n}") + F.col(f"__g_{n}")).alias(f"__o_{n}") for n in sums])
    own = rows.withColumns({f"__v_{n}": F.sum(f"__v_{n}").over(of_stretch) for n in sums}).join(offsets, [group, "__s"])
    own = own.withColumns({n: (F.coalesce(f"__v_{n}", F.lit(0)) + F.col(f"__o_{n}")).cast("long") for n in sums})
    return own.drop("__s", "__f", *[f"__{x}_{n}" for n in sums for x in "vo"])


def place(df: DataFrame, group: str, key: str, tie: list[str], width: int, out: str = "place") -> DataFrame:
    """Row number within each group by a whole number ``key`` and ties, without a window over the group."""
    return running(df, group, key, tie, width, **{out: F.lit(1)})


def beside(df: DataFrame, group: str, place: str, column: str, step: int, out: str) -> DataFrame:
    """``df`` with the value that ``column`` has ``step`` places on, null beyond the ends: lead and lag for groups of any size."""
    other = df.select(group, (F.col(place) - step).alias(place), F.col(column).alias(out))
    return df.join(other, [group, place], "left")
