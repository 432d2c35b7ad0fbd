"""Record linkage and entity resolution on PySpark DataFrames."""
