"""Readers and writers, and the views that the registered queries run over."""
