"""Symbols of source files: scanners for indented and for braced languages, and their table functions."""
