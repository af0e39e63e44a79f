"""Side-scan-sonar survey analytics on Spark DataFrames."""
