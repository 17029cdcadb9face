"""Spectral shape analysis of large collections of triangle meshes, as DataFrame operators."""
