"""Array kernels in numpy, free of Spark; the operators run them per recording or segment in Arrow groups."""
