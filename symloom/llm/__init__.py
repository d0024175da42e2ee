"""Training-data operators: cleaning, de-duplication, mixing, tokenising and archiving of text."""
