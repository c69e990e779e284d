"""Operators for text and code collections; nothing outside this folder imports it."""
