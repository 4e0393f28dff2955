"""Column expressions shared by operators, and the few Arrow-batched helpers."""
