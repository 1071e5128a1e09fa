"""Catalog, order-history and next-offer analytics as plain DataFrame functions."""
