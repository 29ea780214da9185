"""Kinmatch streaming."""
