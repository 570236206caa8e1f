"""Training-data operators: quality, chat, packing, near-dedup, HTML, rules, subwords, toxicity, shards, neighbours."""
