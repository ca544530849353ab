"""Column functions and small helpers that several operators use."""
