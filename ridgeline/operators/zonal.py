"""Zonal statistics with zeros for empty zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.scalar import SQUARE_METRES_PER_ACRE, finite, round_even
from ridgeline.operators.ranking import quantiles


def zonal(values: DataFrame, zones: DataFrame, zone: str, measures: dict[str, str], q: float = 0.9) -> DataFrame:
    """Per row of ``zones``: ``cells`` and, per measure, mean, max and exact
    quantile, to four decimals; zones without values have zeros, and a
    maximum is never below zero.

    ``measures`` maps an output prefix to a column of ``values``.
    """
    aggs = [F.count("*").alias("cells")]
    for name, column in measures.items():
        v = F.col(column).cast("double")
        aggs += [F.avg(v).alias(f"{name}_mean"), F.max(v).alias(f"{name}_max"), F.percentile(v, q).alias(f"{name}_p90")]
    got = values.groupBy(zone).agg(*aggs)
    out = [F.col(zone), F.coalesce("cells", F.lit(0)).cast("long").alias("cells")]
    for name in measures:
        for part in ("mean", "max", "p90"):
            x = F.coalesce(f"{name}_{part}", F.lit(0.0))
            out.append(round_even(F.greatest(x, F.lit(0.0)) if part == "max" else x, 4).alias(f"{name}_{part}"))
    return zones.select(zone).distinct().join(got, zone, "left").select(*out)


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    """``part`` in percent of ``whole``; 0 where there is nothing."""
    return round_even(F.when(whole > 0, part / whole).otherwise(0.0) * 100, digits)


def usable(cells: DataFrame, zones: DataFrame, zone: str, slope: str, most: float = 15.0, cell_area: float = 100.0, lake: Column | None = None) -> DataFrame:
    """Per zone: cells of at most ``most`` slope in acres and in percent, of
    those that have a finite slope and are not of the ``lake``; no mask of the
    analysis applies here."""
    land = finite(F.col(slope)) if lake is None else finite(F.col(slope)) & ~F.coalesce(lake, F.lit(False))
    got = cells.where(land & F.col(zone).isNotNull()).groupBy(zone).agg(F.count("*").alias("n"), F.count_if(F.col(slope) <= most).alias("ok"))
    n, ok = F.coalesce("n", F.lit(0)), F.coalesce("ok", F.lit(0))
    return zones.select(zone).distinct().join(got, zone, "left").select(
        zone, round_even(ok * cell_area / SQUARE_METRES_PER_ACRE, 2).alias("usable_acres"), share(ok, n).alias("usable_pct")
    )


def layer_report(values: DataFrame, layer: str, value: str) -> DataFrame:
    """Per layer: maximum, mean and the share of cells above zero."""
    v = F.col(value).cast("double")
    return values.groupBy(layer).agg(F.max(v).alias("max_v"), F.avg(v).alias("mean_v"), (F.avg((v > 0).cast("double")) * 100).alias("nonzero_pct"))


def colour_scale(values: DataFrame, metric: str, eye: str, value: str, q: float = 0.98, nodata: float = -9998.0) -> DataFrame:
    """Per metric the largest, over eye heights, of the ``q`` quantile of
    positive values above ``nodata``; 1 where there are none."""
    v = F.col(value).cast("double")
    pos = values.select(F.struct(metric, eye).alias("layer"), v.alias("v")).where((F.col("v") > nodata) & (F.col("v") > 0))
    per = quantiles(pos, q, "layer").select(F.col(f"layer.{metric}").alias(metric), "q")
    return values.select(metric).distinct().join(per, metric, "left").groupBy(metric).agg(F.coalesce(F.max("q"), F.lit(1.0)).alias("vmax"))
