"""sources of tessera."""
