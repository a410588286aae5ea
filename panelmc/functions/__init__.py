"""Column functions: numerics, randomness, distributions, arrays, lookup tables, calendar and units."""
