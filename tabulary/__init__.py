"""Analytics over archives of official publications, written for PySpark."""
