"""Table operators: DataFrame in, DataFrame out, with column names as arguments."""
