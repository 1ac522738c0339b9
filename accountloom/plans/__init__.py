"""Plans of the account-intelligence engine."""
