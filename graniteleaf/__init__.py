"""graniteleaf: retrieval, retrieval evaluation and text-corpus operators on Spark DataFrames."""
