"""Relational operators over source files, lines, findings and design documents."""
