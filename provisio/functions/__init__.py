"""functions of the legal-text engine."""
