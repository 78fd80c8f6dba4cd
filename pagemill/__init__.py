"""pagemill: web-content migration and site-quality analytics on PySpark."""

__version__ = "0.1.0"
