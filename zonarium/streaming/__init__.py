"""Zonal sums over pixel streams."""
