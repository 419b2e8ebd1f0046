"""runeflow: text analysis over document collections as Spark DataFrames."""
