"""DataFrame-to-DataFrame operators. Only ``pivot_matrix`` and ``viewer_pivot`` may run a Spark action,
because the names of their output columns depend on the data."""
