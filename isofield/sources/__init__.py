"""Inputs: level sets from tables, analytic shapes, meshes and parameter files."""
