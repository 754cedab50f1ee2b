"""leadlens: evidence-based lead intelligence expressed as Spark DataFrames."""
