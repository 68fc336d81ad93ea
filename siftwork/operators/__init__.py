"""siftwork.operators."""
