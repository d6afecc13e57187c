"""Operators for preparing training data: licences, tokens, chats, archives, near duplicates, shards, quality, packing."""
