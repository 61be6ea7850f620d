"""Training-data operators: token counts, classifiers, deduplication, decontamination, media, language models."""
