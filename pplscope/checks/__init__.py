"""Every operator as a query over the test tables, most with an equivalent SQL text."""
