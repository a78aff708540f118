"""Reference joins: card profiles, enrichment of transactions, nearby merchants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import haversine_km
from ..sources.shared import kept

#: Merchants up to so many rows are replicated; more are joined by a shuffle.
REPLICATE_ROWS = 200_000
NEAR_KM = 50.0
LEAST_NEAR = 3
#: How much wider each circle is, and half of the way around the earth.
GROWTH = 4.0
EARTH_KM = 20_040.0


def card_profiles(cards: DataFrame, customers: DataFrame) -> DataFrame:
    """Card with customer; a card whose customer is missing has no profile."""
    return cards.join(customers, "customer_id").select("card_id", "customer_id", "status", "daily_limit_minor", "currency", "risk_tier", "home_country", "home_lat", "home_lon")


def enrich(transactions: DataFrame, profiles: DataFrame, merchants: DataFrame) -> DataFrame:
    """transaction, card_profile, merchant as structs; a struct is null where the join misses. Null transactions go.

    Merchants are replicated if their count allows, so that the shuffle by card serves the per-card steps as well.
    """
    txn = transactions.select(F.col("card_id").alias("__card"), F.col("merchant_id").alias("__merchant"), F.struct(*transactions.columns).alias("transaction")).where("transaction.transaction_id is not null")
    cards = profiles.select(F.col("card_id").alias("__card"), F.struct(*profiles.columns).alias("card_profile"))
    shops = merchants.select(F.col("merchant_id").alias("__merchant"), F.struct(*merchants.columns).alias("merchant"))
    if not merchants.isStreaming and merchants.limit(REPLICATE_ROWS + 1).count() <= REPLICATE_ROWS:
        shops = F.broadcast(shops)
    return txn.join(cards, "__card", "left").join(shops, "__merchant", "left").select("transaction", "card_profile", "merchant")


def within(homes: DataFrame, places: DataFrame, radius_km: float) -> DataFrame:
    """Columns of both sides and km of all places (lat, lon) within ``radius_km`` of a home (home_lat, home_lon): an equi-join
    on the cells of a grid about as wide as the radius. Each home looks at the cells around it, more of them towards the
    poles."""
    step = min(90.0, radius_km / 110.0)
    wide = max(1, int(360 / step))
    lat_cell, lon_cell = lambda y: F.floor(y / step), lambda x: F.floor((x + 180.0) * wide / 360.0)
    there = places.withColumn("y", lat_cell(F.col("lat"))).withColumn("x", F.pmod(lon_cell(F.col("lon")), F.lit(wide)))
    # cells that the radius can span at the home's farthest latitude, on either side
    reach = F.cos(F.radians(F.least(F.abs(F.col("home_lat")) + step, F.lit(90.0))))
    span = F.least(F.lit(wide // 2), F.ceil(step * wide / 360.0 / F.greatest(F.lit(1e-6), reach)))
    columns = F.array_distinct(F.transform(F.sequence(lon_cell(F.col("home_lon")) - span, lon_cell(F.col("home_lon")) + span), lambda x: F.pmod(x, F.lit(wide))))
    around = homes.withColumn("y", F.explode(F.sequence(lat_cell(F.col("home_lat")) - 1, lat_cell(F.col("home_lat")) + 1))).withColumn("x", F.explode(columns))
    km = haversine_km(F.col("home_lat"), F.col("home_lon"), F.col("lat"), F.col("lon"))
    return around.join(there, ["x", "y"]).withColumn("km", km).where(F.col("km") <= radius_km).drop("x", "y")


def nearby_merchants(cards: DataFrame, merchants: DataFrame, near_km: float = NEAR_KM, least: int = LEAST_NEAR) -> DataFrame:
    """card_id, merchant_id, km, rank: merchants within ``near_km`` of the card's home, or the ``least`` nearest.

    Homes that find too few look again in a circle ``GROWTH`` times as wide, round by round, until it holds enough or all
    of the earth; a round's circle held too few one round before, so it rarely holds many. Homes and merchants are paired
    by place: cards at one home share its search, and beyond the first circle merchants at one place are their ``least``
    first, as no more of them can count. So pairs grow with the number of places, whatever lies at each.
    """
    home, place = ["home_lat", "home_lon"], ["lat", "lon"]
    cards = cards.select("card_id", *home).where("home_lat is not null and home_lon is not null")
    shops = merchants.select("merchant_id", *place).where("lat is not null and lon is not null")
    first = F.row_number().over(Window.partitionBy(*place).orderBy("merchant_id")) <= least
    places = kept(shops.withColumn("__first", first).groupBy(*place).agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("__first"), F.col("merchant_id"))).alias("ids")))
    rank = F.row_number().over(Window.partitionBy(*home).orderBy("km", "merchant_id"))
    left, found, radius = kept(cards.select(*home).distinct()), None, near_km
    while True:
        last = radius >= EARTH_KM
        got = within(left, places, radius).withColumn("__n", F.sum("n").over(Window.partitionBy(*home)))
        got = got if last else got.where(F.col("__n") >= least)
        if radius == near_km:
            got = got.drop("n", "__n", "ids").join(shops, place)
        else:
            # beyond the first circle only the nearest count
            got = got.select(*home, "km", F.explode("ids").alias("merchant_id"))
        got = got.select(*home, "merchant_id", "km", rank.alias("rank"))
        enough = kept(got if radius == near_km else got.where(F.col("rank") <= least))
        found = enough if found is None else found.unionByName(enough)
        if not last:
            left = kept(left.join(enough.select(*home).distinct(), home, "left_anti"))
        if last or not left.head(1):
            return cards.join(found, home).select("card_id", "merchant_id", "km", "rank")
        radius = min(radius * GROWTH, EARTH_KM)
