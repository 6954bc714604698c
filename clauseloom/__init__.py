"""Evidence and clause analytics over corpora of parsed documents, on Spark DataFrames."""
