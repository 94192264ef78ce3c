"""Change-data folding on Spark: row-level change events in, nested documents out."""

from cdcgold.spec import ChildSpec, ProfileSpec

__all__ = ["ChildSpec", "ProfileSpec"]
