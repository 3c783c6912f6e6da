"""The engine and the registered queries."""
