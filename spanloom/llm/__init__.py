"""Training-data operators: dedup, quality, language, mixing, media, licences and tokenisation."""
