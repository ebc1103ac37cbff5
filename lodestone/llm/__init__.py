"""Training-data operators: near-duplicates, filters, archives, scoring, mixing and binary output.

Nothing outside this subpackage imports it.
"""
