"""Readers: explicit schemas, text coerced to types, missing columns reported while the plan is built."""
