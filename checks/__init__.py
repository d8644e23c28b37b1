"""Registered queries over the synthetic tables and the SQL they are compared with."""
