"""Readers: logs of several shapes to events and interactions, policies, labels, annotations."""
