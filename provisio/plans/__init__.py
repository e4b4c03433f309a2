"""plans of the legal-text engine."""
