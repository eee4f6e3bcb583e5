"""Column expressions: text cleaning, tokenising, dates, numbers and JSON."""
