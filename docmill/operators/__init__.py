"""Search, ranking, classification and aggregation operators on DataFrames."""
