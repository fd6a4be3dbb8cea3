"""Document rules as data: the shipped catalogue, inheritance, and rule tables."""
