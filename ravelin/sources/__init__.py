"""Sources: recursive file scans with converters, tolerant JSON lines, journals, the published knowledge base."""
