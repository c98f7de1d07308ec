"""Where operators put intermediate tables: the shared folder of the cluster."""

from tracewell.sources.storage import fresh_path, materialise, shared_dir

__all__ = ["fresh_path", "materialise", "shared_dir"]
