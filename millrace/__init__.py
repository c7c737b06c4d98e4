"""A retrieval and corpus analytics engine on Spark DataFrames."""
