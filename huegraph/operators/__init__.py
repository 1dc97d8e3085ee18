"""Operators on edge lists: collisions, linear algebra, tiling, sectioning."""
