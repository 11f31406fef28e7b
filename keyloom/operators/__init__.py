"""Maps, sets, priority queues, vectors and folds."""
