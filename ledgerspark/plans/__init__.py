"""Composite jobs built from the operators: layers, marts, slices, search, enrichment."""
