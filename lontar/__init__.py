"""lontar: document extraction, record analytics and corpus preparation on Spark DataFrames."""
