"""Features, rules, decisions, limits, enrichment and statistics as DataFrame plans."""
