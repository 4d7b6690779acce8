"""DataFrame to DataFrame steps: decode, prep, sampling, training, evaluate, cluster, graph."""
