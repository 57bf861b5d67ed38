"""The queries run by the driver: library operators over the given tables, each with its SQL check."""
