"""plumbline: deterministic context assembly for retrieval, expressed as Spark plans."""
