"""Counts kept up to date while candidates arrive."""
