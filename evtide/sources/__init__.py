"""Table schemas, readers, adapters from the driver tables, sinks, generators."""
