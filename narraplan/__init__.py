"""Planning of narrated media on Spark: every operator takes and returns DataFrames."""
