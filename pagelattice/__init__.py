"""pagelattice: document layout and text analytics on Spark DataFrames."""
