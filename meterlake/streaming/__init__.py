"""Growing log files as a stream, and a ledger that follows it."""
