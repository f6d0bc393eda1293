"""Test-table adapters, the registered queries and their SQL oracle."""
