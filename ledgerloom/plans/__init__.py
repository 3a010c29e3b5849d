"""Registered queries over the derived views, each with the SQL that it is checked against."""
