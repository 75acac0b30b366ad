"""Column functions: text, identity, file operations and routing."""
