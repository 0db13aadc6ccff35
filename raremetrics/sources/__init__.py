"""Readers and writers: shot-log CSV, SST CSV, whitespace grids, shared parquet tables."""
