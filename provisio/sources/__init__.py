"""sources of the legal-text engine."""
