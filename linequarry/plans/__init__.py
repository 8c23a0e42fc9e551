"""Query explanation and result formats."""
