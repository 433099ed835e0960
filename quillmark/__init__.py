"""Answer-sheet reading and classical test analysis as Spark jobs."""
