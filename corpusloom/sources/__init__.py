"""Reading documents, and writing exports and keyed tables."""
