"""Readers and writers: street networks, gazetteers, GeoJSON, result caches."""
