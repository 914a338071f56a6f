"""Training-data operators: filters, deduplication, decontamination and token output."""
