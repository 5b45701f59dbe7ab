"""DuckDB text of the entities in ``sources.tables``."""

from parcelscope.plans.registry import shared

shared("e_orders", """
select order_id, customer_id, order_status, order_purchase_timestamp,
  case when order_id % 97 != 0 then order_purchase_timestamp + to_seconds(cast((order_id*31) % 7200 as bigint)) end order_approved_at,
  order_purchase_timestamp + to_seconds(cast(86400 + (order_id*104729) % 172800 as bigint)) order_delivered_carrier_date,
  case when order_status='delivered' or order_id % 600 = 0
       then order_purchase_timestamp + to_seconds(cast(172800 + (order_id*1299709) % 1728000 as bigint)) end order_delivered_customer_date,
  cast(cast(order_purchase_timestamp as date) as timestamp) + to_days(cast(12 + order_id % 13 as int)) order_estimated_delivery_date
from (select o_orderkey order_id, o_custkey customer_id,
    o_orderdate + to_seconds(cast((o_orderkey*7919) % 86400 as bigint)) order_purchase_timestamp,
    case when o_orderkey % 50 = 0 then 'canceled' when o_orderkey % 37 = 0 then 'unavailable'
         when o_orderkey % 29 = 0 then 'shipped' else 'delivered' end order_status
  from orders) p""")
shared("e_items", """
select l_orderkey order_id, cast(l_linenumber as bigint) order_item_id, l_partkey product_id, l_suppkey seller_id,
  l_shipdate shipping_limit_date, l_extendedprice price,
  ((cast(round(l_extendedprice*100) as bigint) * cast(round(l_tax*100) as bigint)) // 100) / 100.0::double freight_value
from lineitem""")


def _party(table, p, key, out, extra=""):
    return f"""
select {p}_{key} {out}_id, lpad(cast({p}_{key} % 5000 as varchar), 5, '0') {out}_zip_code_prefix,
  n_name || ' city ' || ({p}_{key} % 7) {out}_city,
  case when {p}_{key} % 83 != 0 then n_name end {out}_state{extra}
from {table} left join nation on n_nationkey = {p}_nationkey"""


shared("e_customers", _party("customer", "c", "custkey", "customer", ", c_custkey // 2 customer_unique_id"))
shared("e_sellers", _party("supplier", "s", "suppkey", "seller"))
shared("e_products", """
select p_partkey product_id, case when p_partkey % 61 != 0 then p_type end product_category_name,
  10 + p_partkey % 50 product_name_lenght, 100 + p_partkey % 900 product_description_lenght,
  p_partkey % 6 product_photos_qty,
  case when p_partkey % 53 = 0 then null when p_partkey % 101 = 0 then 0.0::double else p_size * 100.0::double end product_weight_g,
  case when p_partkey % 59 != 0 then cast(10 + p_size % 13 as double) end product_length_cm,
  cast(10 + p_size % 7 as double) product_height_cm, cast(10 + p_size % 11 as double) product_width_cm
from part""")
shared("e_payments", """
select order_id, cast(s as bigint) payment_sequential,
  case (order_id + s) % 5 when 0 then 'credit_card' when 1 then 'boleto' when 2 then 'voucher'
    when 3 then 'debit_card' else 'not_defined' end payment_type,
  (order_id * 7 + s) % 11 payment_installments,
  (case when order_id % 5 != 0 then cents when s = 1 then cents // 3 else cents - cents // 3 end) / 100.0::double payment_value
from (select *, unnest(case when order_id % 5 = 0 then [1, 2] else [1] end) s from (
  select o_orderkey order_id, coalesce(item_cents, cast(round(o_totalprice * 100) as bigint))
    + case o_orderkey % 10 when 7 then 1 when 8 then 50 when 9 then 500 else 0 end cents
  from orders left join (
    select order_id, cast(sum(cast(round(price * 100) as bigint) + cast(round(freight_value * 100) as bigint)) as bigint) item_cents
    from e_items group by 1) i on i.order_id = o_orderkey
  where o_orderkey % 1499 != 0))""")
shared("e_reviews", """
select order_id * 2 review_id, order_id, 1 + order_id % 5 review_score,
  case when order_id % 3 = 0 then 'title ' || (order_id % 11) end review_comment_title,
  order_purchase_timestamp + to_days(20) review_creation_date,
  order_purchase_timestamp + to_days(22) review_answer_timestamp
from e_orders where order_id % 13 != 0""")
shared("e_geolocation", """
select lpad(cast(z as varchar), 5, '0') geolocation_zip_code_prefix,
  case when z % 71 = 0 and i = 1 then 95.0::double else -33 + ((z*7919) % 3900) / 100.0::double + (i * (z % 4)) * 0.01::double end geolocation_lat,
  -72 + ((z*104729) % 3900) / 100.0::double + (i * (z % 4)) * 0.01::double geolocation_lng,
  'city ' || (z % 7) geolocation_city,
  'NATION_' || (case when z % 97 = 0 and i = 2 then (z + 1) % 25 else z % 25 end) geolocation_state
from (select c_custkey % 5000 z from customer union select s_suppkey % 5000 from supplier) zz,
  (values (0), (1), (2)) ii(i)
where z % 89 != 0""")
shared("e_translation", """
select distinct p_type product_category_name, lower(p_type) product_category_name_english
from part where length(p_type) % 2 = 0""")
shared("e_municipal", """
select year, uf, city, cast(k as varchar) id_municipio,
  case when k % 19 != 0 then cast(20000 + k * 13 + (year - 1995) * 500 as bigint) end population,
  case when k % 23 != 0 then (k * 7919 + (year - 1995) * 100000) * 1.0::double end gdp_current
from (select *, length(uf) * 1000 + cast(right(city, 1) as int) * 37 + cast(substring(uf, 8) as int) * 101 k
  from (select distinct customer_state uf, customer_city city from e_customers where customer_state is not null) p,
       (select unnest(generate_series(1995, 2001)) "year") y)""")
shared("e_fuel", """
select cast(year(order_purchase_timestamp) as bigint) "year", cast(month(order_purchase_timestamp) as bigint) "month",
  customer_state uf, customer_city city,
  case order_id % 4 when 0 then 'OLEO DIESEL' when 1 then 'DIESEL S10' when 2 then 'OLEO DIESEL S10' else 'GASOLINA' end product,
  3 + ((order_id * 37) % 200) / 100.0::double mean_price, order_id % 6 n_posts
from e_orders join e_customers using (customer_id)
where customer_state is not null and customer_id % 7 != 3""")

shared("o_core", """
select order_id, count(*) item_count, count(distinct product_id) unique_product_count,
  count(distinct seller_id) unique_seller_count, sum(price) total_price, avg(price) mean_price, max(price) max_price,
  min(price) min_price, max(price) - min(price) price_range, sum(freight_value) total_freight,
  avg(freight_value) mean_freight, max(freight_value) max_freight, sum(price) + sum(freight_value) merchandise_plus_freight,
  sum(freight_value) / nullif(sum(price), 0) freight_price_ratio
from e_items group by order_id""")
shared("o_features", """
select o.order_id, o.order_purchase_timestamp prediction_time, a.order_id is not null has_order_items, a.* exclude (order_id)
from e_orders o left join o_core a on a.order_id = o.order_id""")
shared("o_outcomes", """
select order_id, order_status, order_delivered_customer_date, order_estimated_delivery_date,
  order_delivered_customer_date is not null and order_estimated_delivery_date is not null target_observed,
  case when order_delivered_customer_date is not null and order_estimated_delivery_date is not null
    then cast(order_delivered_customer_date as date) > cast(order_estimated_delivery_date as date) end late_delivery_calendar_day
from e_orders""")
shared("o_sup", """
select f.*, y.late_delivery_calendar_day from o_features f join o_outcomes y using (order_id)
where f.has_order_items and y.target_observed and lower(trim(y.order_status)) = 'delivered'""")
shared("o_task", """
select *, cast(cast(order_delivered_customer_date as date) > cast(order_estimated_delivery_date as date) as int) late,
  strftime(order_purchase_timestamp, '%Y-%m') purchase_month,
  datediff('day', cast(order_estimated_delivery_date as date), cast(order_delivered_customer_date as date)) lateness_calendar_days
from e_orders where lower(trim(order_status)) = 'delivered' and order_purchase_timestamp is not null
  and order_delivered_customer_date is not null and order_estimated_delivery_date is not null""")
