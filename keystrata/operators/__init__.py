"""Relational forms of the store's commands and bulk jobs."""
