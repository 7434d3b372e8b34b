"""Analytics for data gathered from the web, as Spark DataFrames."""
