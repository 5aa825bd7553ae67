"""Table sources: scans by name, seeds, typed literals."""
