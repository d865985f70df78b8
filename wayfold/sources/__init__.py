"""Readers and writers of segment, turn, tag and boundary tables."""
