"""Turnout: attendance analytics for admission-controlled events, on PySpark."""
