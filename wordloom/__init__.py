"""wordloom: statistical text prediction and corpus analytics expressed as Spark plans."""
