"""Ready-made pipelines."""
