"""Training-data operators: archives, scoring, deduplication, decontamination and packing."""
