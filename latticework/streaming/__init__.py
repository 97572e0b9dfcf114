"""Incremental and streaming maintenance of the catalogue."""
