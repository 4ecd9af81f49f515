"""Named pipelines: what is read, and which transforms follow in which order."""
