"""Plan helpers shared by operators: durable intermediate tables, size-checked broadcasts, graph iterations."""
