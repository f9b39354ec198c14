"""Column expressions: road classes, traffic, geometry, text helpers."""
