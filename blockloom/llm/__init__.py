"""Training-data operators: media payloads, chat, URLs, tokens, dedup, quality, toxicity, packing.

Nothing outside this package imports it.
"""
