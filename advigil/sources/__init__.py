"""Readers of report files, signal files, saved lookups and documents."""
