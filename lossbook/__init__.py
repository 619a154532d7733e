"""lossbook: credit-loss analytics on Spark DataFrames."""
