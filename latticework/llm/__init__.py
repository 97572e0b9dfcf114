"""Training-data operators: scans, dedup, language ID, mixing, tokenisation.

Nothing outside this folder imports it; it may be deleted as a whole.
"""
