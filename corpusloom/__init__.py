"""corpusloom: corpus analytics declared on Spark DataFrames."""
