"""Spark jobs over drum notation at corpus scale: every job takes and returns DataFrames."""
