"""Joins, windows, fitted statistics, document analytics, quality, evaluation and models."""
