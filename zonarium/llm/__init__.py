"""Operators for preparing large text corpora, one module each; nothing outside this subpackage imports them."""
