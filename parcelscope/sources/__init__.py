"""parcelscope sources."""
