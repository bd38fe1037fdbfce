"""Plans: test tables as the engine's inputs, the query catalogue, and whole flows."""
