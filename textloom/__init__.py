"""Operators that turn page dumps and document collections into knowledge tables, as DataFrame transformations."""
