"""Micro-batch ledger append."""
