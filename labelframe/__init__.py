"""labelframe: immutable, labelled, ordered tables on PySpark DataFrames."""
