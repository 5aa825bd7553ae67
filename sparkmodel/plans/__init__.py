"""Models, contexts, scheduling, state and plans."""
