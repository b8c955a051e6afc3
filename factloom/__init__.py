"""factloom: code and text facts as relations, analysed with Spark DataFrames."""
