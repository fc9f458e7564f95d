"""Column expressions and small DataFrame helpers; everything here is lazy."""
