"""Type mappings and column expressions."""
