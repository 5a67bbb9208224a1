"""Operations of a training-data pipeline: screening, near-duplicates, packing, sharding, scoring, formatting, fixity."""
