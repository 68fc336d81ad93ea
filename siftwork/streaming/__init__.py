"""siftwork.streaming."""
