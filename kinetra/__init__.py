"""kinetra: Spark jobs for trial segmentation, domain adaptation and paired statistics."""
