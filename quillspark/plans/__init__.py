"""Configurations and the plans built from them."""
