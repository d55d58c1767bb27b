"""Compositions of operators into feature tables, labels, masters, models and answers."""
