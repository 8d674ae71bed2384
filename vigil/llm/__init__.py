"""Operations of a training-data pipeline, and their queries."""
