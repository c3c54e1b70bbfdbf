"""Column expressions: time, calendar, cleaning."""
