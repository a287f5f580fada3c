"""Post-processing of recognised text and images, as Spark plans."""
