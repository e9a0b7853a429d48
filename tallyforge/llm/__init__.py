"""Operators for preparing training corpora; nothing outside this subpackage imports it."""
