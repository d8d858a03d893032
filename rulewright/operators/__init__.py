"""Typing, instances, patterns, scoring, rule sets, recommendations, serving, evaluation, storage: DataFrame to DataFrame."""
