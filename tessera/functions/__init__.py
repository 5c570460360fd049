"""Lattices and set functions."""
