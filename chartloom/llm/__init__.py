"""Operators on free text and on names for training data. Nothing outside this subpackage imports it."""
