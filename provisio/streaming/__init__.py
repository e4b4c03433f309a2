"""streaming of the legal-text engine."""
