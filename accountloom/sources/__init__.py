"""Sources of the account-intelligence engine."""
