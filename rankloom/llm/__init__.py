"""Training-data operators: token counts, mixing, BPE, WARC, fingerprints,
toxicity, language ID, personal data, audio fingerprints, similarity join."""
