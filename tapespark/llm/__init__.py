"""Training-data operators: scoring, language, privacy, secrets, decontamination, dedup, packing, chat."""
