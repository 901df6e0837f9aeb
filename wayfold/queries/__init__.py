"""Queries over the network that plans.network makes, each with its SQL."""
