"""Entity read-outs: each adapted entity as the later operators see it."""
from pyspark.sql import functions as F

from parcelscope.plans.registry import query


def _ent(name, cols):
    select = ", ".join(cols)
    query(f"entity_{name}", f"select {select} from e_{name}")(lambda t, n=name, cs=cols: getattr(t, n).select(*cs))


_ent("orders", ["order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at",
     "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date"])
_ent("items", ["order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value"])
_ent("customers", ["customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state"])
_ent("sellers", ["seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"])
_ent("products", ["product_id", "product_category_name", "product_weight_g", "product_length_cm", "product_height_cm",
     "product_width_cm", "product_photos_qty"])
_ent("payments", ["order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value"])
_ent("geolocation", ["geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng", "geolocation_state"])
_ent("municipal", ["year", "uf", "city", "id_municipio", "population", "gdp_current"])
_ent("fuel", ["year", "month", "uf", "city", "product", "mean_price", "n_posts"])
_ent("reviews", ["review_id", "order_id", "review_score", "review_creation_date"])
