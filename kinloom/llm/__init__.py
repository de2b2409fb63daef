"""Training-data operators. Nothing outside this subpackage imports it; it may use the core."""
