"""Training-data operators: quality rules, deduplication, mixing, packing, token files.

One module per operator; ``registry`` lists the ten queries.  Nothing outside this
subpackage imports it.
"""
