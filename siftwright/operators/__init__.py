"""Relational operators: cleaning, discretizing, counting, scoring, selecting, evaluating."""
