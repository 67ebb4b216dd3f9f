"""Operations of a large training-data pipeline on tables of documents.  Nothing else in the library imports this."""
