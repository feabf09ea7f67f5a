"""Rule tables and column functions."""
