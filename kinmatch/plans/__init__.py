"""Kinmatch plans."""
