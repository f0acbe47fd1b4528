"""Composed analyses over the operators."""
