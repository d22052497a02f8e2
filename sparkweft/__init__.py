"""Set-at-a-time analytics over typed graphs of program facts, as Spark DataFrames."""
