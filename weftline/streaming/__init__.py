"""Extensions that run the pipelines on unbounded input; the batch pipelines do not need them."""
