"""Training-data operators: classification, scanning, deduplication, decontamination and packing.

Nothing outside this subpackage imports it.
"""
