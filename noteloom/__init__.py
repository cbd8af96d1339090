"""noteloom: notes, facts, catalogues, messages and search as Spark DataFrames."""
