"""The operators bound to concrete tables: registered queries and, where SQL can say the same, SQL."""
