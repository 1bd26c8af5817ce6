"""Plumbline: data-quality profiling, checking, cleansing and loading on Spark DataFrames."""
