"""Operators for preparing training data; an add-on that the rest of the library never imports."""
