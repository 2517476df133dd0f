"""Registered query catalogue (Spark plans) and their SQL oracles."""
