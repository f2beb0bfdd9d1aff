"""DataFrame operators: geometry, resolving, deduplication, snapshots."""
