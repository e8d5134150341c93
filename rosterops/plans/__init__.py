"""Whole jobs composed of operators, and the mapping from benchmark tables to inputs."""
