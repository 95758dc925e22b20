"""Column builders: they stay inside Catalyst."""
