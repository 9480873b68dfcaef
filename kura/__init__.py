"""kura: release-catalog analytics on PySpark DataFrames."""
