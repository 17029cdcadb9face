"""Dense linear algebra on one mesh or one small table, in numpy. Only what no built-in operator can express."""
