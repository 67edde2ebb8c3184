"""Keyed, time-ordered building blocks that stay balanced when one key dominates."""
