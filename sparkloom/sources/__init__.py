"""Reading into, and writing out of, the engine."""
