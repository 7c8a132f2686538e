"""Training-data operators: search, privacy, quality, tokens, toxicity, near-duplicates, decontamination, sharding, archives,
packing, ranked search, language-model scores, conversation repair.

Nothing outside this subpackage imports it.
"""
