"""Filter building, probing, auditing and statistics over DataFrames."""
