"""Scoring of cases while they run."""
