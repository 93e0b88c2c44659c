"""Ready-made reports: each takes a TripTables and returns a lazy DataFrame."""
