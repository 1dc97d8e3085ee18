"""Graph colouring statistics and sparse-matrix operators on Spark DataFrames."""
