"""Software-birthmark analytics on Spark: extraction, comparison and storage as DataFrame plans."""

__version__ = "0.1.0"
