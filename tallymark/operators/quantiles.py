"""Exact per-group quantiles that never gather a group in one task.

A mergeable sketch, one pass over the column, bounds where each wanted rank can
lie. A second pass folds everything between those bounds to one row per group and
gap, and keeps single values only inside them. Both passes are aggregates with
map-side partials, and the column is stored nowhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.operators.joins import join_null_safe
from tallymark.session import materialize

c = F.col
VALUES = 50_000  # different values that one window orders at most
PARTS = 4096
ACCURACY = 5000  # the sketch misses a rank by a share of 1/ACCURACY at most
_LOWEST, _HIGHEST = float("-inf"), float("nan")  # a NaN sorts behind everything, as in any order by value


def _slacks(accuracy: int) -> list[float]:
    """Shares of the ranks that bounds may leave on either side; a small group needs more to hold the next rank."""
    return sorted({2 / accuracy, *(s for s in (0.01, 0.1) if s > 2 / accuracy)})


def _narrowed(needed: DataFrame, wanted: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Splits cells of more than ``VALUES`` different values between their own bounds, until no wanted one is larger.

    Cells of a fixed width say nothing about data that lies close together; the
    parts follow from the smallest and largest value of the cell itself.
    """
    x = c("v").cast("double")
    cell = [*keys, "cell"]
    while True:
        sizes = needed.groupBy(*cell).agg(F.count("*").alias("values"), F.min(x).alias("low"), F.max(x).alias("high"))
        large = materialize(sizes.filter((c("values") > VALUES) & (c("low") < c("high"))), "large")
        if large.isEmpty():
            return needed, wanted
        joined = join_null_safe(needed, large, cell, "left")
        # a value's own place keeps parts of one double apart from none: equal doubles share a part
        part = F.coalesce(F.floor((x - c("low")) / (c("high") - c("low")) * PARTS), F.lit(0)).cast("bigint")
        split = joined.withColumn("part_no", part).drop("values", "low", "high")
        counts = split.groupBy(*cell, "part_no").agg(F.sum("n").alias("rows"), F.min("begin").alias("from"))
        before = Window.partitionBy(*cell).orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
        spans = counts.withColumn("from", c("from") + F.coalesce(F.sum("rows").over(before), F.lit(0)))
        spans = materialize(spans.select(*cell, "part_no", c("from").alias("begin"), (c("from") + c("rows")).alias("upto"),
                                         F.xxhash64("cell", "part_no").alias("next")), "parts")
        wanted = materialize(join_null_safe(wanted.drop("begin"), spans, cell)
                             .filter("rank >= begin AND rank < upto").drop("cell", "part_no", "upto")
                             .withColumnRenamed("next", "cell"), "ranks")
        kept = join_null_safe(split.drop("begin"), spans.drop("upto"), [*cell, "part_no"])
        kept = kept.drop("cell", "part_no").withColumnRenamed("next", "cell")
        needed = materialize(join_null_safe(kept, wanted.select(*keys, "cell").distinct(), cell), "values")


def _sketched(rows: DataFrame, keys: list[str], probs: dict[str, float], accuracy: int, slacks: list[float] | None) -> DataFrame:
    """Per group, for each quantile ``q``: a value not above it (``q_from``) and one not below it (``q_upto``).

    Of ``slacks`` the smallest is taken that is worth two ranks of the group beyond
    the error of the sketch; a group too small for any keeps all its values.
    """
    chosen = _slacks(accuracy) if slacks is None else slacks
    shares = [min(1.0, max(0.0, p + side * s)) for p in probs.values() for side in (-1, 1) for s in chosen]
    # a NaN would break the order inside the sketch; it lies where the infinity lies, behind all numbers
    x = F.when(F.isnan("x"), float("inf")).otherwise(c("x"))
    found = rows.groupBy(*keys).agg(F.percentile_approx(x, shares, accuracy).alias("_at"), F.count("*").alias("_n"))
    fits = [F.lit(True) if slacks is not None else c("_n") * (s - 1 / accuracy) >= 2 for s in chosen]

    def bound(number: int, none: float) -> Column:
        at = [F.get("_at", F.lit(number * len(chosen) + k)) for k in range(len(chosen))]
        out = reduce(lambda rest, k: F.when(fits[k], at[k]).otherwise(rest), reversed(range(len(chosen))), F.lit(none))
        return out if none == _LOWEST else F.when(out == float("inf"), _HIGHEST).otherwise(out)

    return found.select(*keys, *[e for k, q in enumerate(probs) for e in (
        bound(2 * k, _LOWEST).alias(f"{q}_from"), bound(2 * k + 1, _HIGHEST).alias(f"{q}_upto"))])


def _fold(rows: DataFrame, keys: list[str], bounds: DataFrame, bands: list[tuple[Column, Column]]) -> DataFrame:
    """One row per group and gap between ``bands`` with count, least and largest value; one per value inside a band.

    A cell is the number of band edges behind a value, so cells are ordered as the
    values are, and each lies wholly inside bands or outside.
    """
    placed = join_null_safe(rows, bounds, keys)
    edges = [(c("x") >= low).cast("int") + (c("x") > high).cast("int") for low, high in bands]
    inside = reduce(lambda a, b: a | b, ((c("x") >= low) & (c("x") <= high) for low, high in bands))
    cell = reduce(lambda a, b: a + b, edges).cast("bigint")
    placed = placed.select(*keys, cell.alias("cell"), F.when(inside, c("v")).alias("v"), inside.alias("single"), "x")
    return placed.groupBy(*keys, "cell", "v", "single").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))


def _ranks(folded: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """0-based ranks on both sides of each quantile position p * (total - 1), with the cell that holds them."""
    by_cell = folded.groupBy(*keys, "cell").agg(F.sum("n").alias("n"), F.first("single").alias("single"))  # a few cells per group
    group = Window.partitionBy(*keys)
    upto = group.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = by_cell.select(*keys, "cell", "single", F.sum("n").over(upto).alias("end"), "n", F.sum("n").over(group).alias("total"))
    entries = []
    for q, p in probs.items():
        position = f"({float(p)!r}D * (total - 1))"
        entries += [f"named_struct('q', '{q}', 'side', {side}, 'rank', floor({position}) + {side},"
                    f" 'part', {position} - floor({position}))" for side in (0, 1)]
    return (ends.select(*keys, "cell", "single", (c("end") - c("n")).alias("begin"), "end", F.expr(f"explode(array({', '.join(entries)}))").alias("w"))
            .filter("w.rank >= begin AND w.rank < end").select(*keys, "cell", "single", "begin", "w.*"))


def _quantiles(folded: DataFrame, rows: DataFrame, keys: list[str], probs: dict[str, float], bounds: DataFrame,
               bands: list[tuple[Column, Column]]) -> DataFrame:
    wanted = materialize(_ranks(folded, keys, probs), "ranks")
    cell = [*keys, "cell"]
    needed = join_null_safe(folded.filter("single").select(*cell, "v", "n"), wanted.select(*cell, "begin").distinct(), cell)
    complete = wanted.filter("NOT single").isEmpty()
    if not complete:
        # a sketch that missed by more than it may: the values of that gap are fetched as well
        missed = wanted.filter("NOT single").select(*cell, "begin").distinct()
        placed = join_null_safe(rows, bounds, keys)
        edges = [(c("x") >= low).cast("int") + (c("x") > high).cast("int") for low, high in bands]
        placed = placed.select(*keys, reduce(lambda a, b: a + b, edges).cast("bigint").alias("cell"), "v")
        needed = needed.unionByName(join_null_safe(placed, missed, cell).groupBy(*cell, "begin", "v").agg(F.count("*").alias("n")))
    wanted = wanted.drop("single")
    if not complete or folded.count() > VALUES:  # else no cell holds more values than one window orders
        needed, wanted = _narrowed(materialize(needed, "values"), wanted, keys)
    inside = Window.partitionBy(*keys, "cell").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stepped = needed.withColumn("last", c("begin") + F.sum("n").over(inside)).select(
        *keys, "cell", c("v").cast("double").alias("v"), (c("last") - c("n")).alias("first"), "last")
    found = (join_null_safe(stepped, wanted.drop("begin"), [*keys, "cell"]).filter("rank >= first AND rank < last").groupBy(*keys, "q")
             .agg(F.max("part").alias("part"), F.max(F.when(c("side") == 0, c("v"))).alias("low"),
                  F.max(F.when(c("side") == 1, c("v"))).alias("high")))
    # equal ends need no arithmetic, which keeps an infinity between infinities
    high = F.coalesce("high", "low")
    at = F.when((c("part") == 0) | (c("low") == high), c("low")).otherwise(c("low") * (1.0 - c("part")) + high * c("part"))
    return found.groupBy(*keys).agg(*[F.max(F.when(c("q") == q, at)).alias(q) for q in probs])


def _values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.filter(c(value).isNotNull()).select(*keys, c(value).alias("v"), c(value).cast("double").alias("x"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], accuracy: int = ACCURACY,
                    slacks: list[float] | None = None) -> DataFrame:
    """Linear-interpolated quantiles per group, e.g. ``{"q1": 0.25}``. Without keys the whole column is one group."""
    if not keys:
        return exact_quantiles(df.withColumn("_whole", F.lit(0)), ["_whole"], value, probs, accuracy, slacks).drop("_whole")
    rows = _values(df, keys, value)
    bounds = materialize(_sketched(rows, keys, probs, accuracy, slacks), "bounds")
    bands = [(c(f"{q}_from"), c(f"{q}_upto")) for q in probs]
    return _quantiles(materialize(_fold(rows, keys, bounds, bands), "folded"), rows, keys, probs, bounds, bands)


def boxplot(df: DataFrame, category: str, value: str, accuracy: int = ACCURACY, slacks: list[float] | None = None) -> DataFrame:
    """Quartiles, 1.5-IQR whiskers and the number of points outside them.

    The bounds of the quartiles bound the fences as well, so the fold of the second
    pass keeps the values around a fence, too, and whiskers and outliers follow
    from it without another pass.
    """
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    keys = [category]
    rows = _values(df, keys, value)
    sketched = _sketched(rows, keys, probs, accuracy, slacks)
    fences = {"low_from": c("q1_from") - (c("q3_upto") - c("q1_from")) * 1.5, "low_upto": c("q1_upto") - (c("q3_from") - c("q1_upto")) * 1.5,
              "high_from": c("q3_from") + (c("q3_from") - c("q1_upto")) * 1.5, "high_upto": c("q3_upto") + (c("q3_upto") - c("q1_from")) * 1.5}
    finite = reduce(lambda a, b: a & b, (~F.isnan(x) & (F.abs(x) != float("inf")) for x in fences.values()))
    # beyond double the arithmetic says nothing, and all values of the group are kept one by one; the margin covers rounding
    bounds = sketched.select("*", *[F.when(finite, x + F.abs(x) * (-1e-12 if name.endswith("_from") else 1e-12))
                                    .otherwise(F.lit(_LOWEST if name.endswith("_from") else _HIGHEST)).alias(name) for name, x in fences.items()])
    bounds = materialize(bounds, "bounds")
    bands = [(c(f"{q}_from"), c(f"{q}_upto")) for q in (*probs, "low", "high")]
    folded = materialize(_fold(rows, keys, bounds, bands), "folded")
    quartiles = _quantiles(folded, rows, keys, probs, bounds, bands)
    fence = (c("q3") - c("q1")) * 1.5
    limits = quartiles.select("*", (c("q1") - fence).alias("low_fence"), (c("q3") + fence).alias("high_fence"))
    cells = materialize(join_null_safe(folded, limits, keys), "cells")
    inside = "(low >= low_fence AND high <= high_fence)"
    across = f"NOT {inside} AND high >= low_fence AND low <= high_fence"
    if not cells.filter(across).isEmpty():  # a sketch that missed: every row is held against the fences
        limits = cells.select(*keys, *probs, "low_fence", "high_fence").distinct()
        cells = join_null_safe(rows, limits, keys).withColumns({"low": c("x"), "high": c("x"), "n": F.lit(1).cast("bigint")})
    return (cells.groupBy(category, "q1", "median", "q3")
            .agg(F.expr(f"min(low) FILTER (WHERE {inside})").alias("whisker_low"),
                 F.expr(f"max(high) FILTER (WHERE {inside})").alias("whisker_high"),
                 F.expr(f"coalesce(sum(n) FILTER (WHERE NOT {inside}), 0)").alias("outliers"), F.sum("n").alias("n_points")))
