"""Spark-native analytics over ensembles, networks and perturbation grids."""
