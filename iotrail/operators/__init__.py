"""DataFrame-to-DataFrame operators: ordering, correlation, intervals, graphs, sampling."""
