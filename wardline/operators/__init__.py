"""Operators on cohorts, daily panels and models."""
