"""Table profiling, quality audit, preparation and analysis as Spark DataFrame plans."""
