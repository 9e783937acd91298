"""Publishing: atomic tables and documents, receipts, backups."""
