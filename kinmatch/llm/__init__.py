"""Operations of training-data pipelines over a table of documents."""
