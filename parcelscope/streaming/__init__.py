"""Placeholder: the delivery-analytics surface is batch only, so no streaming operator is defined.

The strict point-in-time rule in ``parcelscope.operators.pit`` plays the part late-data rules
would play in a stream.
"""
