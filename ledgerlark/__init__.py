"""Analytics over append-only observation journals: DataFrame in, DataFrame out."""
