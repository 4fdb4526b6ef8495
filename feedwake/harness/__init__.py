"""Registered queries: library operators over chain tables derived from the test tables, with their SQL twins."""
