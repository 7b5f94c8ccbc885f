"""Extractors and analyses that turn text and tables into typed rows."""
