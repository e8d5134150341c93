"""Sources and sinks: cell grids, text blocks, manifests, evidence tables, reports."""
