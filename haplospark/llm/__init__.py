"""Training-data operators: quality, mixing, language models, decontamination,
near-duplicates, classifiers, link graphs, token files, toxicity, personal data."""
