"""Column functions over records of episodic data."""
