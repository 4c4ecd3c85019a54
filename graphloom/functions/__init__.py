"""Functions over vertex values, visit distributions and seeded draws."""
