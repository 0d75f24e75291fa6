"""driftsum: weighted clustering summaries and data operators over changing tables, on Spark DataFrames."""
