"""Training-data operators: secrets, mixing, decontamination, joins, tokens, PII, archives, media, languages."""
