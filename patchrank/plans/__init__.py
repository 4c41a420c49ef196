"""Reports that compose several operators."""
