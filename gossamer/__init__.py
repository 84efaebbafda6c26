"""gossamer: web-crawl data as Spark DataFrames."""
