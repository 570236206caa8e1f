"""Query plans over the domain tables."""
