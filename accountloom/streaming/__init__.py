"""Streaming of the account-intelligence engine."""
