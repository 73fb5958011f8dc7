"""The evaluation operators on files that keep arriving."""
