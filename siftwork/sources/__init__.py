"""siftwork.sources."""
