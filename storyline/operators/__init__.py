"""DataFrame operators: ingest, nearest partner, grouping, stories, ordering, agreement."""
