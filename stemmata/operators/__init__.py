"""Relational operators over versioned text: temporal joins, line diffs, lineage, lifecycle, agreement, checks."""
