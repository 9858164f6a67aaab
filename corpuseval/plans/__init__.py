"""Jobs composed of operators: scan, dataset preparation, evaluation, batches, evidence."""
