"""Column functions: text, identifiers, dates, JSON, HTML."""
