"""Training-data operators: language ID, search, mixing, tokenisation, dedup, scans and LM scoring.

Self-contained: nothing outside this folder imports it.
"""
