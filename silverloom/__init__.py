"""silverloom: entity resolution and golden-record analytics on Spark DataFrames."""
