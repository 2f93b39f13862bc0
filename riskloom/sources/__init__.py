"""Readers and writers for price panels, portfolios, views and result stores."""
