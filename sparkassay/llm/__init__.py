"""Operators for preparing training text: filters, near duplicates, decontamination, tokens, page text."""
