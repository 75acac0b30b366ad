"""Request validation, access-path choice and the engine that runs requests."""
