"""objekta: object-style analytics (classes, references, collections) as Spark DataFrame plans."""
