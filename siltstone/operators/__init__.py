"""Operators on DataFrames: chunking, dedup, trees, diffs, snapshots, packs, filters, restore and cache."""
