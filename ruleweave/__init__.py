"""Rules over facts on Spark: recursive Horn programs, ontologies and graph queries as DataFrame plans."""
