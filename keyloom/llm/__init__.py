"""Operators on texts: packing, leakage search, subject areas.  Nothing outside imports this."""
