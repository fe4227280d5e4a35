"""Document retrieval and curation analytics expressed as Spark DataFrames."""
