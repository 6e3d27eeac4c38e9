"""factlens: describe and profile data of any size with Spark."""

from factlens.api import Description, describe, describe_path, list_describers

__version__ = "0.1.0"
__all__ = ["Description", "describe", "describe_path", "list_describers"]
