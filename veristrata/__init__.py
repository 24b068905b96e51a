"""veristrata: statement-verification analytics expressed as Spark plans."""
