"""parcelscope operators."""
