"""Connected components of a distributed edge table: the library's own."""

from tessella.operators.components import connected_components  # noqa: F401
