"""Relational operators over the chunk table and over ordered logs."""
