"""Column functions: value parsing, rule helpers and their fixed values."""
