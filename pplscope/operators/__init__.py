"""DataFrame to DataFrame operators, one module per topic; chain them with `.transform`."""
