"""Rules, expressions and validators."""
