"""Training-data operators. Nothing outside this subpackage imports it, except ``corpus_pipeline``."""
