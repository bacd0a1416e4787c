"""Training-data operators: dedup, filters, decontamination, mixing, token counts, archives."""
