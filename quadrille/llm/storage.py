"""Written tables in the folder that all executors share."""

from ..storage import shared_dir, written

__all__ = ["shared_dir", "written"]
