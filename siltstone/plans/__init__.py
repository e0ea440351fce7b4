"""Composite plans: the commands, and the queries over the driver's tables."""
