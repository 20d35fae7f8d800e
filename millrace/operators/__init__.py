"""DataFrame operators: statistics, labels, scheduling, pixels, search."""
