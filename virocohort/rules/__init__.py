"""Fixed values that results depend on: codes, thresholds, term lists and category names."""
