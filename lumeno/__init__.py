"""lumeno: web-page design measurement and corpus processing on Spark DataFrames."""
