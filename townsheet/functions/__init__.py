"""Column functions: text, time, opening hours, classification rules."""
