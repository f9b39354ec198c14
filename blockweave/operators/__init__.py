"""Relational, geometric and graph operators over street networks."""
