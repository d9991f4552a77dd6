"""DataFrame operators: folding, filtering, joining, aggregating and ranking runs."""
