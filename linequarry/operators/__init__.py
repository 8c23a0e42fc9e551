"""DataFrame operators: search, windows and context, run statistics."""
