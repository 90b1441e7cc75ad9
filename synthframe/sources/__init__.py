"""Sources and sinks: entity tables, datasets, run documents, journals."""
