"""Column-level functions: item bytes and hash families."""
