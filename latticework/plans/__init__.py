"""The query language: grammar, binding to Catalyst expressions, execution."""
