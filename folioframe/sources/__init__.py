"""Readers and writers: files and strings to relational rows, and back."""
