"""Column functions of the term language."""
