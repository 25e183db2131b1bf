"""plans of the revision engine."""
