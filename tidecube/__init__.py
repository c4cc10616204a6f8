"""tidecube: gridded-data analytics expressed with Spark DataFrames."""
