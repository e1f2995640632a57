"""Registered queries over the test tables, each with its answer in plain SQL where SQL can give it."""
