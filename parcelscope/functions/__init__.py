"""parcelscope functions."""
