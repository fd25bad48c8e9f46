"""Protocol configuration, registries and the registered queries."""
