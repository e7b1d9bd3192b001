"""quadlake: oriented-box datasets, detector evaluation and corpus preparation as Spark jobs."""
