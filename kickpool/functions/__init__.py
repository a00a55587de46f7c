"""Column-building helpers shared by every operator."""
