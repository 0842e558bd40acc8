"""Training-data operators: archives, filters, de-duplication, tokens and packing."""
