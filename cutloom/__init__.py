"""Timelines, edits and per-frame analyses as Spark DataFrames."""
