"""Column expressions: money, dates, service levels, text shapes and identities."""
