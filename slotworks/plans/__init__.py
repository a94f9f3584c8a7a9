"""Registered queries over the driver tables, with their ANSI SQL twins."""
