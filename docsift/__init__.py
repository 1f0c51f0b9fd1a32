"""docsift: document retrieval, auditing and corpus processing on PySpark DataFrames."""
