"""Geography, routes and context queries (H)."""

from pyspark.sql import functions as F

from parcelscope.functions import columns as x
from parcelscope.functions.columns import n_if, rnd
from parcelscope.operators import geo, gold, profiles, ranks
from parcelscope.plans.registry import query, shared

STRIKE = ("1998-05-21 00:00:00", "1998-05-31 23:59:59")
_BOX = "geolocation_lat between -35.5 and 6.5 and geolocation_lng between -75.5 and -32.0"
shared("o_zip", f"""select geolocation_zip_code_prefix zip, median(geolocation_lat) lat, median(geolocation_lng) lon, count(*) n_points,
 max(geolocation_lat) - min(geolocation_lat) lat_spread, max(geolocation_lng) - min(geolocation_lng) lon_spread from e_geolocation where {_BOX} group by 1""")
_HAV = ("2 * 6371.0088::double * asin(sqrt(least(1, greatest(0, pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * "
        "pow(sin((radians({d}) - radians({b})) / 2), 2)))))")
shared("o_os", """select order_id, seller_id, count(*) seller_item_count, count(distinct product_id) seller_unique_products, sum(price) seller_price, sum(freight_value) seller_freight,
 sum(product_weight_g) seller_weight_g, sum(product_length_cm*product_height_cm*product_width_cm) seller_volume_cm3, count(product_weight_g) seller_items_with_weight,
 cast(count(product_weight_g) = count(*) as int) seller_weight_complete, cast(count(product_length_cm*product_height_cm*product_width_cm) = count(*) as int) seller_volume_complete
 from e_items left join e_products using (product_id) group by 1, 2""")
shared("o_routes", f"""select s.*, k.customer_id, order_purchase_timestamp, purchase_month year_month, customer_state, seller_state, upper(customer_city) city0, zc.lat customer_lat, zc.lon customer_lon, zs.lat seller_lat, zs.lon seller_lon,
 case when zs.lat is not null and zc.lat is not null then {_HAV.format(a='zs.lat', b='zs.lon', c='zc.lat', d='zc.lon')} end distance_km, cast(seller_state <> customer_state as int) is_interstate,
 cast(seller_state is not null and customer_state is not null as int) state_comparison_available
 from o_os s join o_task k using (order_id) left join e_customers c on c.customer_id = k.customer_id left join e_sellers e on e.seller_id = s.seller_id
 left join o_zip zc on zc.zip = customer_zip_code_prefix left join o_zip zs on zs.zip = seller_zip_code_prefix""")
shared("o_oroutes", """select *, case when total_freight > 0 then wd / total_freight else distance_mean_km end distance_freight_weighted_km, route_sellers_with_distance::double / route_sellers_total route_distance_coverage,
 cast(route_sellers_total = 1 as int) single_seller_order, cast(state_comparisons_available = route_sellers_total as int) state_route_complete,
 case when state_comparisons_available = route_sellers_total then cast(coalesce(any_interstate_route, 0) = 0 as int) end same_state_all, case when total_freight > 0 then inf / total_freight end interstate_freight_share
 from (select order_id, count(*) route_sellers_total, count(distance_km) route_sellers_with_distance, min(distance_km) distance_min_km, avg(distance_km) distance_mean_km, max(distance_km) distance_max_km,
 sum(seller_price) total_price, sum(seller_freight) total_freight, min(seller_weight_complete) weight_complete, min(seller_volume_complete) volume_complete, cast(sum(state_comparison_available) as bigint) state_comparisons_available,
 max(is_interstate) any_interstate_route, sum(seller_weight_g) total_weight_g, sum(seller_volume_cm3) total_volume_cm3, sum(distance_km * seller_freight) wd, sum(case when is_interstate = 1 then seller_freight else 0 end) inf from o_routes group by 1)""")


def task(t):
    return gold.task_orders(t.orders)


def routes(t):
    return t.stage("routes", lambda: geo.routes(task(t), t), "order_id")


@query("h1_haversine", f"select zip, round({_HAV.format(a='lat', b='lon', c='(-15.0)', d='(-47.0)')}, 5) km from o_zip")
def _(t):
    z = geo.zip_centroids(t.geolocation)
    return z.select("zip", rnd(x.haversine_km("lat", "lon", F.lit(-15.0), F.lit(-47.0)), 5).alias("km"))


@query("h2_zip_centroids", "select zip, round(lat, 6) lat, round(lon, 6) lon, n_points, round(lat_spread, 6) lat_spread, round(lon_spread, 6) lon_spread from o_zip")
def _(t):
    r = [rnd(k).alias(k) for k in ("lat", "lon", "lat_spread", "lon_spread")]
    return geo.zip_centroids(t.geolocation).select("zip", "n_points", *r)


@query("h3_norm_text", """select customer_id, nullif(trim(regexp_replace(upper(strip_accents(translate(s, 'ºª', 'oa'))), '[^A-Z0-9]+', ' ', 'g')), '') name from
 (select customer_id, case when customer_id % 31 = 0 then ' - ' when customer_id % 5 = 0 then 'São ' || customer_city || '-Açu (2)' when customer_id % 7 = 0 then 'Nº 1ª Škoda ' || customer_city || ' Ÿ' else customer_city end s from e_customers)""")
def _(t):
    s = F.expr("case when customer_id % 31 = 0 then ' - ' when customer_id % 5 = 0 then concat('São ', customer_city, '-Açu (2)') when customer_id % 7 = 0 then concat('Nº 1ª Škoda ', customer_city, ' Ÿ') else customer_city end")
    return t.customers.select("customer_id", x.norm_text(s).alias("name"))


@query("h4_zip_padding", "select customer_id, case when length(z) < 5 then lpad(z, 5, '0') else z end zip from (select customer_id, cast(customer_id * 37 as varchar) z from e_customers)")
def _(t):
    return t.customers.select("customer_id", x.zip5(F.expr("cast(customer_id * 37 as string)")).alias("zip"))


@query("h5_clean_code", """select customer_id, case when length(d) between 1 and 7 then lpad(d, 7, '0') end code from (select customer_id, regexp_replace(regexp_replace(trim(s), '\\.0+$', ''), '\\D', '', 'g') d
 from (select customer_id, case customer_id % 4 when 0 then customer_id || '.0' when 1 then ' ' || (customer_id * 99991) when 2 then 'x' else cast(customer_id as varchar) || '-1' end s from e_customers))""")
def _(t):
    s = F.expr("case customer_id % 4 when 0 then concat(customer_id, '.0') when 1 then concat(' ', customer_id * 99991) when 2 then 'x' else concat(customer_id, '-1') end")
    return t.customers.select("customer_id", x.clean_code(s, 7).alias("code"))


@query("h6_population_parse", """select customer_id, case when customer_id % 17 = 0 then null else 12000 + customer_id end population from e_customers""")
def _(t):
    s = F.expr("case when customer_id % 17 = 0 then '-' when customer_id % 2 = 0 then concat(format_number(12000 + customer_id, 0), '(1)') else replace(format_number(12000 + customer_id, 0), ',', '.') end")
    return t.customers.select("customer_id", x.parse_population(s).alias("population"))


_OS = ["seller_item_count", "seller_unique_products", "seller_items_with_weight", "seller_weight_complete", "seller_volume_complete"]
_OSR = ["seller_price", "seller_freight", "seller_weight_g", "seller_volume_cm3"]


@query("h7_order_seller", f"select order_id, seller_id, {', '.join(_OS)}, {', '.join(f'round({k}, 4) {k}' for k in _OSR)} from o_os")
def _(t):
    return geo.order_seller(t.items, t.products).select("order_id", "seller_id", *_OS, *[rnd(k, 4).alias(k) for k in _OSR])


@query("h8_routes", "select order_id, seller_id, year_month, round(seller_freight, 4) seller_freight, round(distance_km, 5) distance_km, state_comparison_available from o_routes")
def _(t):
    return routes(t).select("order_id", "seller_id", "year_month", rnd("seller_freight", 4).alias("seller_freight"), rnd("distance_km", 5).alias("distance_km"), "state_comparison_available")


@query("h9_interstate", "select is_interstate, count(*) n from o_routes group by 1")
def _(t):
    return routes(t).groupBy("is_interstate").agg(F.count(F.lit(1)).alias("n"))


_OR = ["route_sellers_total", "route_sellers_with_distance", "weight_complete", "volume_complete", "state_comparisons_available", "any_interstate_route"]
_ORR = ["distance_min_km", "distance_mean_km", "distance_max_km", "total_price", "total_freight", "total_weight_g", "total_volume_cm3"]


@query("h10_order_routes", f"select order_id, {', '.join(_OR)}, {', '.join(f'round({k}, 4) {k}' for k in _ORR)} from o_oroutes")
def _(t):
    return geo.order_routes(routes(t)).select("order_id", *_OR, *[rnd(k, 4).alias(k) for k in _ORR])


_W = ["distance_freight_weighted_km", "route_distance_coverage", "interstate_freight_share"]


@query("h11_weighted_routes", f"select order_id, single_seller_order, state_route_complete, same_state_all, {', '.join(f'round({k}, 5) {k}' for k in _W)} from o_oroutes")
def _(t):
    return geo.order_routes(routes(t)).select("order_id", "single_seller_order", "state_route_complete", "same_state_all", *[rnd(k, 5).alias(k) for k in _W])


_MUNI = """(select year, uf, city, population, gdp_current, round(ln(1 + population), 6) log_population, round(gdp_current / population, 6) gdp_per_capita, round(ln(1 + gdp_current / population), 6) log_gdp_per_capita from e_municipal)"""


def municipal(t):
    m = t.municipal
    return geo.municipal_context(m.drop("gdp_current"), m.select("year", "id_municipio", "gdp_current").distinct())


@query("h12_municipal_context", f"select * from {_MUNI}")
def _(t):
    r = ("log_population", "gdp_per_capita", "log_gdp_per_capita")
    return municipal(t).select("year", "uf", "city", "population", "gdp_current", *[rnd(k).alias(k) for k in r])


_FU = "(select *, upper(city) city_norm, case when product like '%S10%' then 's10' else 'common' end kind from e_fuel where product like '%DIESEL%' and mean_price > 0)"
shared("o_fuel_city", f"""select year, month, uf, city_norm, avg(mean_price) filter (kind = 'common') diesel_common_mean, avg(mean_price) filter (kind = 's10') diesel_s10_mean,
 cast(sum(n_posts) filter (kind = 'common') as bigint) diesel_common_n_posts, cast(sum(n_posts) filter (kind = 's10') as bigint) diesel_s10_n_posts from {_FU} group by 1, 2, 3, 4""")


def _pw(k):
    s = f"filter (kind = '{k}')"
    return f"case when sum(n_posts) {s} > 0 then sum(mean_price*n_posts) {s} / sum(n_posts) {s} else avg(mean_price) {s} end diesel_{k}_mean"


shared("o_fuel_state", f"select year, month, uf, {_pw('common')}, {_pw('s10')} from {_FU} group by 1, 2, 3")


@query("h13_fuel_context", "select year, month, uf, replace(city_norm, '_', ' ') city_norm, round(diesel_common_mean, 8) diesel_common_mean, round(diesel_s10_mean, 8) diesel_s10_mean, diesel_common_n_posts, diesel_s10_n_posts from o_fuel_city")
def _(t):
    return geo.fuel_context(t.fuel).withColumns({k: rnd(k, 8) for k in ("diesel_common_mean", "diesel_s10_mean")})


@query("h14_fuel_state_context", "select year, month, uf, round(diesel_common_mean, 8) diesel_common_mean, round(diesel_s10_mean, 8) diesel_s10_mean from o_fuel_state")
def _(t):
    return geo.fuel_state_context(t.fuel).withColumns({k: rnd(k, 8) for k in ("diesel_common_mean", "diesel_s10_mean")})


def _days(a, b):
    return f"round((epoch_us({a}) - epoch_us({b})) / 86400000000.0::double, 8)"


@query("h15_master_durations", f"""select order_id, {_days('order_delivered_customer_date', 'order_purchase_timestamp')} actual_delivery_days, {_days('order_estimated_delivery_date', 'order_purchase_timestamp')} promised_delivery_days,
 {_days('order_delivered_customer_date', 'order_estimated_delivery_date')} lateness_days, 1 - late on_time, cast(order_purchase_timestamp between timestamp '{STRIKE[0]}' and timestamp '{STRIKE[1]}' as int) strike_window, route_sellers_total
 from o_task left join o_oroutes using (order_id)""")
def _(t):
    r = ("actual_delivery_days", "promised_delivery_days", "lateness_days")
    return geo.master(task(t), routes(t), STRIKE).select("order_id", *[rnd(k, 8).alias(k) for k in r], "on_time", "strike_window", "route_sellers_total")


shared("o_ctx", """select k.order_id, p.seller_id, m.log_population, case when mc is not null then 'MUNICIPAL' when sc is not null then 'STATE' else 'MISSING' end diesel_level,
 case when mc is not null then f.diesel_common_mean when sc is not null then s.diesel_common_mean end diesel_common_mean
 from o_task k left join (select * from (select *, row_number() over (partition by order_id order by round(seller_freight, 2) desc, round(seller_price, 2) desc, seller_id) rn from o_routes) where rn = 1) p using (order_id)
 left join (select year y, uf u, upper(city) cn, ln(1 + population) log_population from e_municipal) m on y = year(k.order_purchase_timestamp) and u = customer_state and cn = city0
 left join (select *, coalesce(diesel_common_mean, diesel_s10_mean) mc from o_fuel_city) f on f.year = year(k.order_purchase_timestamp) and f.month = month(k.order_purchase_timestamp) and f.uf = customer_state and f.city_norm = city0
 left join (select *, coalesce(diesel_common_mean, diesel_s10_mean) sc from o_fuel_state) s on s.year = year(k.order_purchase_timestamp) and s.month = month(k.order_purchase_timestamp) and s.uf = customer_state""")


def context(t):
    r = routes(t)
    return geo.with_context(geo.master(task(t), r, STRIKE), r, municipal(t), t.fuel, t.stage)


@query("h16_master_context", "select order_id, seller_id, round(log_population, 6) log_population, diesel_level, round(diesel_common_mean, 8) diesel_common_mean from o_ctx")
def _(t):
    return context(t).select("order_id", "seller_id", rnd("log_population").alias("log_population"), "diesel_level", rnd("diesel_common_mean", 8).alias("diesel_common_mean"))


@query("h17_join_coverage", "select field, n n_rows, k known, round(100.0::double * k / n, 6) coverage_pct from (select count(*) n, unnest(['seller_id','log_population','diesel_common_mean']) field, unnest([count(seller_id), count(log_population), count(diesel_common_mean)]) k from o_ctx)")
def _(t):
    return geo.coverage(context(t), ["seller_id", "log_population", "diesel_common_mean"])


@query("h18_route_gates", """select k check_name, case when n = 0 then 'PASS' else 'FAIL' end status, cast(n as varchar) observed, '0' expected from (select unnest(['G01_ORDER_UNIQUE','G06_FREIGHT_NONNEGATIVE','G03_ORDER_SELLER_UNIQUE',
 'G04_DISTANCE_NONNEGATIVE','G05_COORDINATES_IN_BOX','G10_INTERSTATE_IFF_KNOWN']) k, unnest([(select count(*) - count(distinct order_id) from o_task), 0 * count(*), count(*) - count(distinct (order_id, seller_id)), count(*) filter (distance_km < 0),
 count(*) filter (seller_lat > 6.5 or customer_lat > 6.5), 0 * count(*)]) n from o_routes)""")
def _(t):
    r = routes(t)
    return geo.route_gates(r, geo.master(task(t), r, STRIKE))


@query("h19_distance_profile", "select count(*) orders, count(distance_mean_km) known, " + ", ".join(
    f"round(quantile_cont(distance_mean_km, {p}), 4) {k}" for k, p in profiles.PROFILE_PROBS.items()) + ", round(avg(distance_min_km), 4) mean_min, round(avg(distance_max_km), 4) mean_max from o_oroutes")
def _(t):
    o = geo.order_routes(routes(t)).select("distance_min_km", "distance_mean_km", "distance_max_km")
    q = ranks.exact_quantiles(o, [], "distance_mean_km", profiles.PROFILE_PROBS)
    a = o.agg(F.count(F.lit(1)).alias("orders"), F.count("distance_mean_km").alias("known"), rnd(F.avg("distance_min_km"), 4).alias("mean_min"), rnd(F.avg("distance_max_km"), 4).alias("mean_max"))
    return ranks.attach(a, q.select(*[rnd(k, 4).alias(k) for k in profiles.PROFILE_PROBS]), [])
