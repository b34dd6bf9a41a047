"""Column functions on bases, codes and intervals."""
