"""Operators over DataFrames of episodes and steps. Long form throughout: one row for each step of an episode."""
