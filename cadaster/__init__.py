"""Property and company due-diligence analytics expressed as Spark DataFrames."""
