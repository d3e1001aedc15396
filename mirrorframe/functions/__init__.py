"""Column-level functions (URL, HTML, CSS, network)."""
