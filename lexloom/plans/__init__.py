"""Query plans over the test tables."""
