"""Table contracts, readers, writers and the mapping of the sales tables."""
