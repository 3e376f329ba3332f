"""Column-to-column helpers: rules, text, display and model output."""
