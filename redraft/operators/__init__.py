"""operators of the revision engine."""
