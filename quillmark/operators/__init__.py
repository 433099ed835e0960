"""Scoring, norms, item analysis, merging, edits, reports, geometry and mark reading."""
