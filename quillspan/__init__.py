"""quillspan: span extraction, auditing and deduplication of segmented text corpora as Spark plans."""
