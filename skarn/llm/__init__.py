"""Training-data operators: packing, search, near-duplicates, scans, scoring, mixing, chat rendering."""
