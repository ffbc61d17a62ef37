"""Registered queries over graph tables derived from the driver's tables."""
