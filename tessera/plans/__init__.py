"""Registered queries and the SQL that they are compared with."""
