"""The registered queries and, for each, SQL that computes the same on another engine."""
