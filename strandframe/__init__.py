"""strandframe: residue-feature analytics as plain Spark DataFrame functions."""
