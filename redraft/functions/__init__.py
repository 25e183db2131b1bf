"""functions of the revision engine."""
