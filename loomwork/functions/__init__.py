"""Column expressions and driver-side formulas."""
