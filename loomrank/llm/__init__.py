"""Training-data operators: packing, fingerprints, quality, privacy, tokenisers, toxicity, licences, chat, joins.

Nothing outside this package imports it; ``loomrank.llm.registry`` lists its queries.
"""
