"""Column functions: text indicators, JSON and state rules, vectors, sets. Built-in expressions only, no Python UDFs."""
