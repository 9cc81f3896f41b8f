"""Training-data operators: archives, duplicates, neighbours, chat, tokenizers, sharding.

Nothing outside this subpackage imports it.
"""
