"""Operators as plain functions from DataFrame to DataFrame."""
