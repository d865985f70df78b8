"""Training-data operators: quality, language models, URL filters, tokenizers, deduplication, archives."""
