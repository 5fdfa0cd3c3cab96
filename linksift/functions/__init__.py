"""Column expressions: text, urls, dates, rules, coercion, presentation."""
