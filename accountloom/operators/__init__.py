"""Operators of the account-intelligence engine."""
