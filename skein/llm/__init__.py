"""Operations of a training-data pipeline, each over a whole table of documents, pages or benchmark items."""
