"""Training-data operators: search, tokenisation, filters, deduplication, mixing and packing.

Nothing else in the library imports this subpackage; delete the folder and the rest still works.
"""
