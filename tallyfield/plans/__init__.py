"""Whole jobs: raw tables to star schema, reports, features, models."""
