"""siftwork.functions."""
