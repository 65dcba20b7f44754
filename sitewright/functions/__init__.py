"""Column functions: geometry, text rules, units, seeded draws."""
