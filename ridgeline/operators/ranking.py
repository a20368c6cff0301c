"""Weighted scoring over fixed-population percentiles.

A metric's percentile is the midpoint rank among all rows with a valid value;
filters come after, so that they never change the score of a row that stays.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.scalar import finite, round_up
from ridgeline.session import cut

#: Cut points per metric that spread a population over tasks.
CUTS = 32
#: Values that are broadcast at most with their rank (32 bytes each).
OFTEN = 50_000


@dataclass(frozen=True)
class Metric:
    """A scored column; ``positive`` takes only values above zero as valid."""

    id: str
    label: str
    group: str
    column: str
    low_is_good: bool = False
    positive: bool = False

    def valid(self) -> Column:
        v = F.col(self.column).cast("double")
        return finite(v) & (v > 0) if self.positive else finite(v)

    def value(self) -> Column:
        return F.when(self.valid(), F.col(self.column).cast("double"))


def metrics(eye: str = "2m", destinations: list[tuple[str, str]] = ()) -> list[Metric]:
    """The registry for an eye height: eight metrics and one per destination
    (id, label); names and groups are fixed values."""
    return [
        Metric("lake_area", "Visible lake area", "View", f"area_{eye}_p90_ac"),
        Metric("perceived", "Perceived lake size", "View", f"solid_{eye}_p90"),
        Metric("lot_size", "Lot size", "Property", "acres", positive=True),
        Metric("usable", "Usable low-slope area", "Property", "usable_acres"),
        Metric("shore", "Shoreline proximity", "Property", "shore_dist_m", low_is_good=True),
        Metric("land_value", "Land affordability", "Value", "land_value", low_is_good=True, positive=True),
        Metric("improvements", "Assessed improvements", "Value", "improvement_value"),
        Metric("asking", "Asking-price affordability", "Value", "list_price", low_is_good=True, positive=True),
        *(Metric(f"route_{i}", label, "Access", f"drive_{i}_min", low_is_good=True) for i, label in destinations),
    ]


#: Weights of the presets; each sums to 100.
PRESETS: dict[str, dict[str, int]] = {
    "balanced": {
        "lake_area": 25, "perceived": 20, "lot_size": 10, "usable": 10, "shore": 10, "land_value": 10,
        "route_i68": 5, "route_honi": 2, "route_wisp": 3, "route_grocery": 3, "route_hospital": 2,
    },
    "view": {"lake_area": 40, "perceived": 35, "shore": 15, "lot_size": 5, "usable": 5},
    "vacant": {
        "lake_area": 18, "perceived": 12, "lot_size": 15, "usable": 20, "shore": 10, "land_value": 10,
        "route_i68": 5, "route_grocery": 5, "route_hospital": 5,
    },
    "home": {
        "lake_area": 20, "perceived": 15, "lot_size": 5, "usable": 5, "shore": 10, "land_value": 5, "improvements": 10,
        "route_i68": 10, "route_honi": 5, "route_wisp": 5, "route_grocery": 5, "route_hospital": 5,
    },
    "access": {
        "lake_area": 10, "perceived": 10, "lot_size": 5, "usable": 5, "shore": 5,
        "route_i68": 20, "route_honi": 10, "route_wisp": 10, "route_grocery": 15, "route_hospital": 10,
    },
}
#: Property filter that a preset sets.
PRESET_FILTER = {"vacant": "vacant", "home": "improved"}


def long_form(df: DataFrame, id_col: str, chosen: list[Metric]) -> DataFrame:
    """(id, metric, v) of all valid values."""
    pairs = F.array(*[F.struct(F.lit(m.id).alias("metric"), m.value().alias("v")) for m in chosen])
    return df.select(F.col(id_col).alias("id"), F.explode(pairs).alias("x")).select("id", "x.metric", "x.v").where("v is not null")


def ranked(values: DataFrame, by: str = "metric", value: str = "v") -> DataFrame:
    """(by, value, ties, first, n): every distinct value of a group, how many
    rows have it, how many rows are below it, and the group's rows.

    Cut points per group deal the distinct values to buckets; running counts
    are taken inside a bucket, and bucket totals give the offsets, so that no
    task sees a whole population.
    """
    counts = values.groupBy(by, value).agg(F.count("*").alias("ties"))
    cuts = counts.groupBy(by).agg(F.percentile_approx(value, [i / CUTS for i in range(1, CUTS)], 1000).alias("cuts"))
    counts = counts.join(cuts, by)  # a row per group; broadcast by its size or shuffled
    counts = counts.withColumn("bucket", F.expr(f"size(filter(cuts, c -> c < {value}))")).drop("cuts")
    inside = Window.partitionBy(by, "bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(by, "bucket").agg(F.sum("ties").alias("total"))
    over = Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        by, "bucket", F.coalesce(F.sum("total").over(over), F.lit(0)).alias("offset"), F.sum("total").over(Window.partitionBy(by)).alias("n")
    )
    out = counts.withColumn("before", F.coalesce(F.sum("ties").over(inside), F.lit(0))).join(totals, [by, "bucket"])
    return out.select(by, value, "ties", (F.col("offset") + F.col("before")).alias("first"), "n")


def midpoint_percentiles(values: DataFrame, by: str = "metric", value: str = "v") -> DataFrame:
    """``values`` with ``p``: the midpoint of its tied ranks over n - 1, in
    each group ``by``; 0.5 in a population of one.

    Ranks come back to rows by value.  Values with more than one of ``OFTEN``
    rows are fewer than that by counting and are broadcast; no other value is
    a large part of the shuffle.
    """
    ranks = ranked(values, by, value)
    p = F.when(F.col("n") <= 1, F.lit(0.5)).otherwise((F.col("first") + F.col("first") + F.col("ties") - 1) / F.lit(2.0) / (F.col("n") - 1))
    ranks = cut(ranks.select(by, value, p.alias("p"), "ties"))
    often = F.col("ties") > -(-(ranks.agg(F.sum("ties")).first()[0] or 0) // OFTEN)
    hot, rest = F.broadcast(ranks.where(often).drop("ties")), ranks.where(~often).drop("ties")
    return values.join(hot, [by, value]).unionByName(values.join(hot, [by, value], "left_anti").join(rest, [by, value]))


def lot_filter(kind: str = "any", residential: bool = False, min_acres: float = 0.0) -> Column:
    """Rows with view cells, of a property kind (any, vacant, improved)."""
    keep = F.coalesce(F.col("cells"), F.lit(0)) > 0
    built = F.coalesce(F.col("year_built"), F.lit(0)) != 0
    if residential:
        keep &= F.coalesce(F.col("land_use"), F.lit("")).rlike("(?i)Residential|Town House")
    if kind != "any":
        keep &= ~built if kind == "vacant" else built
    return keep & (F.coalesce(F.col("acres"), F.lit(0.0)) >= min_acres)


def score(df: DataFrame, id_col: str, registry: list[Metric], weights: dict[str, int], keep: Column | None = None) -> DataFrame:
    """Scored candidates: columns of ``df``, ``score`` (one decimal) and
    ``breakdown`` (label, value, utility, weight per active metric).

    Metrics of weight 0 are not evaluated; a candidate needs a valid value in
    all others.  Without any weight there are no candidates.
    """
    active = [m for m in registry if weights.get(m.id, 0) > 0]
    if not active:
        empty = df.limit(0).withColumn("score", F.lit(None).cast("double"))
        return empty.withColumn("breakdown", F.lit(None).cast("array<struct<label:string,value:double,utility:double,weight:int>>"))
    df = cut(df)  # the population is read for cut points, counts, ranks and candidates
    ranks = midpoint_percentiles(long_form(df, id_col, active))
    wide = ranks.groupBy("id").pivot("metric", [m.id for m in active]).agg(F.first("p"))
    wide = wide.select(F.col("id").alias(id_col), *[F.col(m.id).alias(f"__p_{m.id}") for m in active])
    kept = df if keep is None else df.where(keep)
    kept = kept.where(reduce(lambda a, b: a & b, [m.valid() for m in active])).join(wide, id_col)
    utility = {m.id: 100 * (1 - F.col(f"__p_{m.id}") if m.low_is_good else F.col(f"__p_{m.id}")) for m in active}
    total = float(sum(weights[m.id] for m in active))
    mean = reduce(lambda a, b: a + b, [utility[m.id] * float(weights[m.id]) for m in active]) / total
    parts = [F.struct(F.lit(m.label).alias("label"), m.value().alias("value"), utility[m.id].alias("utility"), F.lit(weights[m.id]).alias("weight")) for m in active]
    out = kept.withColumn("score", round_up(mean, 1)).withColumn("breakdown", F.array(*parts))
    return out.drop(*[f"__p_{m.id}" for m in active])


def top(df: DataFrame, id_col: str, by: str = "score", k: int = 20) -> DataFrame:
    """The ``k`` best rows; ties keep the order of ids, nulls do not rank."""
    return df.where(F.col(by).isNotNull()).orderBy(F.col(by).desc(), F.col(id_col)).limit(k)


def upper_medians(values: DataFrame, by: str = "metric", value: str = "v") -> DataFrame:
    """Per group the element at index n // 2 of the sorted values, and n; on
    counts of distinct values in buckets, as percentiles are."""
    r = ranked(values, by, value).where(F.floor(F.col("n") / 2).between(F.col("first"), F.col("first") + F.col("ties") - 1))
    return r.select(by, F.col(value).alias("upper_median"), "n")


def quantiles(values: DataFrame, q: float, by: str = "metric", value: str = "v") -> DataFrame:
    """(by, q): per group the ``q`` quantile, between its two neighbours in
    proportion; on counts of distinct values in buckets."""
    at = q * (F.col("n") - 1)
    r = ranked(values, by, value).withColumn("at", at).withColumn("low", F.floor("at")).withColumn("high", F.ceil("at"))
    holds = lambda place: F.col(place).between(F.col("first"), F.col("first") + F.col("ties") - 1)
    r = r.where(holds("low") | holds("high")).groupBy(by).agg(
        F.max(F.when(holds("low"), F.col(value))).alias("a"), F.max(F.when(holds("high"), F.col(value))).alias("b"), F.first(F.col("at") - F.col("low")).alias("f")
    )
    return r.select(by, (F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).alias("q"))


def message(scored: DataFrame, weights: dict[str, int]) -> DataFrame:
    """(text): one row that says why there are no candidates; no row if there
    are some."""
    if not any(w > 0 for w in weights.values()):
        return scored.sparkSession.createDataFrame([("No metric has a weight.",)], "text string")
    said = "No lot has a value for every weighted metric and passes the filters"
    said += "; only lots with a listing have an asking price." if weights.get("asking", 0) > 0 else "."
    return scored.limit(1).agg(F.count("*").alias("n")).where("n = 0").select(F.lit(said).alias("text"))
