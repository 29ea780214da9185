"""Kinmatch functions."""
