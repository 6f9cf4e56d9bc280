"""Plans: the end-to-end build, its cube, SQL views,
plan inspection and the oracle comparison used by tests."""
