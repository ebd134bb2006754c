"""Terrain hydrology and earthworks analytics on Spark."""
