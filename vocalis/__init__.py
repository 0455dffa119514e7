"""vocalis: signal forensics and corpus preparation expressed as Spark DataFrames."""
