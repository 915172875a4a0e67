"""Cash-flow analytics and reconciliation on Spark DataFrames."""
