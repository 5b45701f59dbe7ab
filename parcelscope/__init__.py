"""parcelscope: order-fulfilment analytics as PySpark DataFrame operators."""
