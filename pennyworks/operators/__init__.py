"""Ledger operators."""
