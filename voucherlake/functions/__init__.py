"""Column helpers: money, dates, text classes, keys, labels, review wording."""
