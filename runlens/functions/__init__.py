"""Column builders: JSON, messages, time, text similarity, templates."""
