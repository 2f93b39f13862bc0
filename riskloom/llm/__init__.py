"""Training-data operators: dedup, filters, decontamination, mixing and token packing.

Nothing else in the library imports this subpackage.
"""
