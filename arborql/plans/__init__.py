"""Matchers to DataFrame plans."""
