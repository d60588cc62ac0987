"""Ledger streaming."""
