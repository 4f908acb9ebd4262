"""Operators on graphs given as edge tables."""
