"""Query plans over the registered tables."""
