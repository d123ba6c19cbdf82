"""The status ledger over a stream of events."""
