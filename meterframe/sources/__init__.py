"""Inputs: meter payload documents, contracts, day-ahead prices, the fact table."""
