"""Whole commands: mining, serving and reports from events to tables."""
