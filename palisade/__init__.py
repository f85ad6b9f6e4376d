"""Analysis of code changes against policy at batch scale, on Spark DataFrames."""
