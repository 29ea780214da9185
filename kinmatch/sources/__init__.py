"""Kinmatch sources."""
