"""Operators on level sets, meshes and particles."""
