"""operators of the legal-text engine."""
