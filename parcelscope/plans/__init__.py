"""parcelscope plans."""
