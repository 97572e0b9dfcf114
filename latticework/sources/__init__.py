"""Readers: source trees, extracted entities, framework routes, ledgers."""
