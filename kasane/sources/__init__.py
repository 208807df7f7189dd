"""Release packages: inventory, readers, adapters, the table store."""
