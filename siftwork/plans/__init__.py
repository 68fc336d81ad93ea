"""siftwork.plans."""
