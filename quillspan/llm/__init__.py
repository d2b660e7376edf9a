"""Training-data operators: mixing, filtering, deduplication, decontamination and privacy.

Nothing outside this subpackage imports it.
"""
