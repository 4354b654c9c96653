"""landfold: a PySpark engine for landed social-content payloads."""
