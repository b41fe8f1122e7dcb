"""strata: medallion operators for Spark. Every operator is a lazy function of DataFrames; see plans for whole runs."""
