"""Bars from tables of ticks, CSV files and Parquet; outputs as long tables and JSON."""
