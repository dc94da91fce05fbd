"""DataFrame-to-DataFrame operators; every column is an argument."""
