"""Column builders: rules, parsers, bands."""
