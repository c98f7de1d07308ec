"""Connected components, as the library has them, in joins to the last edge."""

from functools import partial

from tracewell.operators import graph

connected_components = partial(graph.connected_components, one_task=0)

__all__ = ["connected_components"]
