"""Column expressions: text, dates, odds, efficiency, scoring."""
