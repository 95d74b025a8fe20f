"""Query plans: registered queries and their SQL oracles."""
