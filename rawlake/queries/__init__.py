"""Every operator as a query over the shared tables, with its check in SQL."""
