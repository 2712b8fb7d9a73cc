"""Rewards of answers as they are logged."""
