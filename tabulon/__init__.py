"""tabulon: curation and evaluation of tables, expressed with Spark DataFrames."""
