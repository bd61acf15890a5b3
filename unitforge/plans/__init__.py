"""Registered queries over the driver's tables, each with its equivalent SQL where SQL can express it."""
