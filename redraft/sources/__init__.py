"""sources of the revision engine."""
