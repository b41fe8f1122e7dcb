"""Readers and writers: JSON, CSV, Parquet, raw documents; run partitions; shared scratch tables."""
