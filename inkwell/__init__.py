"""Text search, indexing and crawl analytics on Spark DataFrames."""
