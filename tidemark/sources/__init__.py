"""Readers and writers: landed files to typed DataFrames and back."""
