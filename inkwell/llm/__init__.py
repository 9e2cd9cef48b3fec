"""Training-data operators: mixing, packing, token files, deduplication,
quality scoring, media matching, chat formatting and licence scans.

Nothing outside this subpackage imports it.
"""
