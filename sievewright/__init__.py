"""Evidence reduction, verification and recall over Spark DataFrames."""
