"""Column functions: no DataFrame, no action, all inside Catalyst."""
