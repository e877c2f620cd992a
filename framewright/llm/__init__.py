"""Operations of a training-data pipeline: scoring, tokenising, de-duplicating, scanning, packing."""
