"""Record linkage by normalised address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.scalar import normalise_address, parse_price


def last_listing(listings: DataFrame, position: str) -> DataFrame:
    """One row (key, list_price, list_url) per address; the last listing wins
    as a whole, even where its price is blank."""
    keyed = listings.select(normalise_address(F.col("address")).alias("key"), parse_price(F.col("price")).alias("list_price"), F.col("url").alias("list_url"), position)
    last = keyed.where("key <> ''").groupBy("key").agg(F.max_by(F.struct("list_price", "list_url"), position).alias("x"))
    return last.select("key", "x.list_price", "x.list_url")


def attach_listings(parcels: DataFrame, listings: DataFrame, address: str, position: str) -> DataFrame:
    """``parcels`` with ``list_price`` and ``list_url``; blank addresses never
    match, and a listing matches every parcel of its address."""
    keyed = parcels.withColumn("key", normalise_address(F.col(address)))
    return keyed.join(last_listing(listings, position), "key", "left").drop("key")


def unmatched_listings(parcels: DataFrame, listings: DataFrame, address: str) -> DataFrame:
    """Listings whose address no parcel has."""
    keys = parcels.select(normalise_address(F.col(address)).alias("key")).where("key <> ''").distinct()
    return listings.withColumn("key", normalise_address(F.col("address"))).join(keys, "key", "left_anti").drop("key")


def join_by_position(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Join two tables that must have the same rows; raises if their counts
    differ."""
    n = left.agg(F.count("*").alias("n_left")).crossJoin(right.agg(F.count("*").alias("n_right")))  # one row each
    ok = n.select(F.assert_true(F.col("n_left") == F.col("n_right"), "row counts differ").alias("ok"), F.lit(1).alias("one"))
    return left.join(right, key).crossJoin(F.broadcast(ok)).where(F.col("ok").isNull()).drop("ok", "one")
