"""Named analyses composed from the operators."""
