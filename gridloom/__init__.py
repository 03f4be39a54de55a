"""gridloom: adaptive-grid and table analytics on PySpark."""
