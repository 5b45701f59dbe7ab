"""Zip centroids, seller to customer routes, regional context and the master table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelscope.functions.columns import days_between, haversine_km, month_key, n_if, norm_text, ratio, zip5
from parcelscope.operators import ranks
from parcelscope.operators.gold import DELIVERED, PROMISED
from parcelscope.operators.joins import checked_join, fallback_join, top_one

#: Rows of a table (some 80 bytes each) that may be broadcast.
BROADCAST_ROWS = 400_000
# fixed values: bounding box of valid coordinates
LAT_BOX, LON_BOX = (-35.5, 6.5), (-75.5, -32.0)


def in_box(lat, lon) -> Column:
    return F.col(lat).between(*LAT_BOX) & F.col(lon).between(*LON_BOX)


def zip_centroids(geolocation: DataFrame) -> DataFrame:
    """Median coordinate, points and spread per zip inside the bounding box."""
    g = geolocation.select(zip5("geolocation_zip_code_prefix").alias("zip"), F.col("geolocation_lat").try_cast("double").alias("lat"),
                           F.col("geolocation_lng").try_cast("double").alias("lon")).filter(in_box("lat", "lon"))
    s = g.groupBy("zip").agg(F.count("lat").alias("n_points"), (F.max("lat") - F.min("lat")).alias("lat_spread"), (F.max("lon") - F.min("lon")).alias("lon_spread"))
    long = ranks.melt(g, ["zip"], ["lat", "lon"])
    m = ranks.exact_quantiles(long, ["zip", "variable"], "value", {"m": 0.5})
    mid = m.groupBy("zip").agg(F.max(F.when(F.col("variable") == "lat", F.col("m"))).alias("lat"), F.max(F.when(F.col("variable") == "lon", F.col("m"))).alias("lon"))
    return mid.join(s, "zip")


def order_seller(items: DataFrame, products: DataFrame) -> DataFrame:
    """Order x seller totals with product weight and volume; sums over all-NULL groups stay NULL."""
    p = products.select("product_id", "product_weight_g", (F.col("product_length_cm") * F.col("product_height_cm") * F.col("product_width_cm")).alias("volume_cm3"))
    n = F.count(F.lit(1))
    # one layout by order serves the distinct count, the sums and joins by order
    return checked_join(items, p, ["product_id"]).repartition("order_id").groupBy("order_id", "seller_id").agg(
        n.alias("seller_item_count"), F.countDistinct("product_id").alias("seller_unique_products"), F.sum("price").alias("seller_price"),
        F.sum("freight_value").alias("seller_freight"), F.sum("product_weight_g").alias("seller_weight_g"), F.sum("volume_cm3").alias("seller_volume_cm3"),
        F.count("product_weight_g").alias("seller_items_with_weight"), (F.count("product_weight_g") == n).cast("int").alias("seller_weight_complete"),
        (F.count("volume_cm3") == n).cast("int").alias("seller_volume_complete"))


def interstate(a, b) -> Column:
    """1 / 0, NULL when either state is unknown."""
    return F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), (F.col(a) != F.col(b)).cast("int"))


def _few(parties: DataFrame) -> bool:
    """Whether a table has so few rows that it may be broadcast, and the large side of its join is not shuffled."""
    return parties.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def routes(task: DataFrame, t) -> DataFrame:
    """Order x seller route rows with both centroids, distance and interstate flag, laid out by order."""
    cen = zip_centroids(t.geolocation).select("zip", "lat", "lon")

    def side(df, p):
        return df.select(F.col(f"{p}_id"), zip5(f"{p}_zip_code_prefix").alias("zip"), norm_text(f"{p}_city").alias(f"{p}_city_norm"), F.col(f"{p}_state")).join(
            cen.select("zip", F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon")), "zip", "left").drop("zip")
    # customers meet the orders, not the wider and more numerous routes; routes stay laid out by order
    o = checked_join(task.select("order_id", "customer_id", "order_purchase_timestamp", F.col("purchase_month").alias("year_month")), side(t.customers, "customer"), ["customer_id"])
    d = order_seller(t.items, t.products).join(o, "order_id")
    sellers = side(t.sellers, "seller")
    d = checked_join(d, F.broadcast(sellers), ["seller_id"]) if _few(t.sellers) else checked_join(d, sellers, ["seller_id"]).repartition("order_id")
    inter = interstate("seller_state", "customer_state")
    km = haversine_km("seller_lat", "seller_lon", "customer_lat", "customer_lon")
    return d.withColumns({"distance_km": km, "is_interstate": inter, "state_comparison_available": inter.isNotNull().cast("int")})


def order_routes(r: DataFrame) -> DataFrame:
    """Order summary: distances, totals, completeness, freight-weighted distance and interstate share."""
    f = F.col("seller_freight")
    g = r.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("route_sellers_total"), F.count("distance_km").alias("route_sellers_with_distance"),
        F.min("distance_km").alias("distance_min_km"), F.avg("distance_km").alias("distance_mean_km"), F.max("distance_km").alias("distance_max_km"),
        F.sum("seller_price").alias("total_price"), F.sum("seller_freight").alias("total_freight"),
        F.min("seller_weight_complete").alias("weight_complete"), F.min("seller_volume_complete").alias("volume_complete"),
        F.sum("state_comparison_available").alias("state_comparisons_available"), F.max("is_interstate").alias("any_interstate_route"),
        F.sum("seller_weight_g").alias("total_weight_g"), F.sum("seller_volume_cm3").alias("total_volume_cm3"),
        F.sum(F.col("distance_km") * f).alias("_wd"), F.sum(F.when(F.col("is_interstate") == 1, f).otherwise(0.0)).alias("_if"))
    paid = F.col("total_freight") > 0
    complete = (F.col("state_comparisons_available") == F.col("route_sellers_total")).cast("int")
    return g.withColumns({
        "distance_freight_weighted_km": F.when(paid, F.col("_wd") / F.col("total_freight")).otherwise(F.col("distance_mean_km")),
        "route_distance_coverage": ratio("route_sellers_with_distance", "route_sellers_total"),
        "single_seller_order": (F.col("route_sellers_total") == 1).cast("int"), "state_route_complete": complete,
        "same_state_all": F.when(complete == 1, (F.coalesce("any_interstate_route", F.lit(0)) == 0).cast("int")),
        "interstate_freight_share": F.when(paid, F.col("_if") / F.col("total_freight"))}).drop("_wd", "_if")


def municipal_context(population: DataFrame, gdp: DataFrame) -> DataFrame:
    """Population joined to GDP on (year, id), with guarded logs."""
    d = checked_join(population, gdp, ["year", "id_municipio"])
    pc = F.when(F.col("population") > 0, F.col("gdp_current") / F.col("population"))
    return d.withColumns({"log_population": F.when(F.col("population") >= 0, F.log1p("population")), "gdp_per_capita": pc,
                          "log_gdp_per_capita": F.when(pc >= 0, F.log1p(pc))})


def _diesel(fuel: DataFrame) -> DataFrame:
    p = norm_text("product")
    return (fuel.filter(p.rlike(r"\bDIESEL\b") & (F.col("mean_price") > 0) & F.col("uf").isNotNull() & (F.col("city") != ""))
            .withColumns({"kind": F.when(p.contains("S10"), "s10").otherwise("common"), "city_norm": norm_text("city")}))


def fuel_context(fuel: DataFrame) -> DataFrame:
    """Mean diesel price and posts by month and place, one column per diesel type."""
    g = _diesel(fuel).groupBy("year", "month", "uf", "city_norm").pivot("kind", ["common", "s10"]).agg(
        F.avg("mean_price").alias("mean"), F.sum("n_posts").alias("posts"))
    return g.select("year", "month", "uf", "city_norm", F.col("common_mean").alias("diesel_common_mean"), F.col("s10_mean").alias("diesel_s10_mean"),
                    F.col("common_posts").alias("diesel_common_n_posts"), F.col("s10_posts").alias("diesel_s10_n_posts"))


def fuel_state_context(fuel: DataFrame) -> DataFrame:
    """Post-weighted state price per diesel type; the simple mean where no posts were counted."""
    price = F.when(F.sum("n_posts") > 0, F.sum(F.col("mean_price") * F.col("n_posts")) / F.sum("n_posts")).otherwise(F.avg("mean_price"))
    g = _diesel(fuel).groupBy("year", "month", "uf").pivot("kind", ["common", "s10"]).agg(price.alias("price"), F.sum("n_posts").alias("posts"))
    return g.select("year", "month", "uf", F.col("common_price").alias("diesel_common_mean"), F.col("s10_price").alias("diesel_s10_mean"))


def primary_seller(r: DataFrame) -> DataFrame:
    """The order's main seller: most freight, then most price, then smallest id."""
    cents = r.select("order_id", "seller_id", "seller_state", "customer_city_norm", "customer_state",
                     F.round("seller_freight", 2).alias("f"), F.round("seller_price", 2).alias("p"))
    return top_one(cents, ["order_id"], ["f", "p"], "seller_id", ["seller_id", "seller_state", "customer_city_norm", "customer_state"])


def durations(task: DataFrame, strike: tuple[str, str]) -> DataFrame:
    """Calendar, durations, label, on-time flag and strike window by order."""
    p = "order_purchase_timestamp"
    return task.select("order_id", F.year(p).cast("long").alias("year"), F.month(p).cast("long").alias("month"), month_key(p).alias("year_month"),
                       F.weekday(p).alias("purchase_dow"), days_between(DELIVERED, p).alias("actual_delivery_days"),
                       days_between(PROMISED, p).alias("promised_delivery_days"), days_between(DELIVERED, PROMISED).alias("lateness_days"),
                       "late", (1 - F.col("late")).alias("on_time"),
                       F.col(p).between(F.lit(strike[0]).cast("timestamp_ntz"), F.lit(strike[1]).cast("timestamp_ntz")).cast("int").alias("strike_window"))


def master(task: DataFrame, r: DataFrame, strike: tuple[str, str]) -> DataFrame:
    """Durations, on-time flag, strike window and the order's route summary."""
    return durations(task, strike).join(order_routes(r), "order_id", "left")


def with_context(m: DataFrame, r: DataFrame, municipal: DataFrame, fuel: DataFrame, kept=lambda name, build: build()) -> DataFrame:
    """Destination municipality values and diesel price: municipal, else state, else MISSING.

    ``kept`` (name, build) may stage the tables by place and month: they are small, and Spark sees that only of written ones.
    """
    base = m.join(primary_seller(r), "order_id", "left").withColumnRenamed("customer_state", "uf").withColumnRenamed("customer_city_norm", "city_norm")
    muni = kept("municipal_places", lambda: municipal.select("year", "uf", norm_text("city").alias("city_norm"), "log_population", "log_gdp_per_capita"))
    base = checked_join(base, muni, ["year", "uf", "city_norm"])
    vals = ["diesel_common_mean", "diesel_s10_mean"]

    def level(df):
        return df.withColumn("known", F.when(F.coalesce(*vals).isNotNull(), 1))
    out = fallback_join(base, [("MUNICIPAL", level(kept("fuel_places", lambda: fuel_context(fuel))), ["year", "month", "uf", "city_norm"]),
                               ("STATE", level(kept("fuel_states", lambda: fuel_state_context(fuel))), ["year", "month", "uf"])], [*vals, "known"], "diesel_level", "known")
    return out.drop("known")


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Known rows and percent per column, one scan."""
    agg = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(k).alias(k) for k in columns])
    return agg.unpivot(["n_rows"], columns, "field", "known").withColumn("coverage_pct", F.round(100.0 * F.col("known") / F.col("n_rows"), 6))


def route_gates(r: DataFrame, m: DataFrame) -> DataFrame:
    """Integrated validation: unique keys, non-negative distance and freight, coordinates in the box."""
    from parcelscope.operators import checks
    bad_s = F.col("seller_lat").isNotNull() & ~in_box("seller_lat", "seller_lon")
    bad_c = F.col("customer_lat").isNotNull() & ~in_box("customer_lat", "customer_lon")
    return checks.union([
        checks.zero_checks(m, {"G01_ORDER_UNIQUE": checks.duplicate_keys(m, ["order_id"]), "G06_FREIGHT_NONNEGATIVE": n_if(F.col("total_freight") < 0)}),
        checks.zero_checks(r, {"G03_ORDER_SELLER_UNIQUE": checks.duplicate_keys(r, ["order_id", "seller_id"]), "G04_DISTANCE_NONNEGATIVE": n_if(F.col("distance_km") < 0),
                               "G05_COORDINATES_IN_BOX": n_if(bad_s | bad_c),
                               "G10_INTERSTATE_IFF_KNOWN": n_if(F.col("is_interstate").isNotNull() != (F.col("state_comparison_available") == 1))})])
