"""Session analytics on Spark: transcripts of coding agents as DataFrames."""
