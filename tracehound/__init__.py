"""Binary-evidence analytics on Spark DataFrames."""
