"""DataFrame steps of the labelling, evaluation and review jobs."""
