"""Readers and writers: mesh files, arrays, plate layouts, result tables."""
