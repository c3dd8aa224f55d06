"""Column expressions: keys, slots, globs, checksums, number text."""
