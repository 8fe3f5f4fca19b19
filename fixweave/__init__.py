"""fixweave: record extraction, comparison and scoring on Spark DataFrames."""
