"""Column functions: ids, sizes, paths, times, kinds and canonical encodings."""
