"""Column expressions: spectral indices, scoring, geometry, text formats."""
