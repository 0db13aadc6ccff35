"""Training-data operators: classification, filtering, deduplication, tokenising, packing.

Nothing outside this subpackage (but for the top-level pipeline and the driver's
entry file) imports it.
"""
