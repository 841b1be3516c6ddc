"""Bitemporal facts, market series and text analytics as DataFrame operators."""
