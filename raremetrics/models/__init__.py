"""Distributed model fits: each pass is one Spark job returning p×p sufficient statistics."""
