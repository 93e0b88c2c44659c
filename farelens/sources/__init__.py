"""Table contract, loading, storing and exporting."""
