"""gleaner: collection analytics and training-data curation on PySpark DataFrames."""
