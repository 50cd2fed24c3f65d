"""Readers and writers with the semantics that the built-in ones do not have."""
