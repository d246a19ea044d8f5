"""Relational operators over tracking tables."""
