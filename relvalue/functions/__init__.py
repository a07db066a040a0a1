"""Column helpers; all of them build Catalyst expressions, none runs Python per row."""
