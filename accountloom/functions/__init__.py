"""Functions of the account-intelligence engine."""
