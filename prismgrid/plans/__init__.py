"""Registered queries over the driver tables, each with its SQL form where one exists."""
