"""File sources, table sinks, load state and stored results."""
