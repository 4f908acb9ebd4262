"""Incremental maintenance of indexes over streams."""
