"""Where jobs cut their lineage: the library's tables in the folder that the cluster shares."""

from tessera.sources.storage import discard, materialize, new_path, shared_folder, small_batches

__all__ = ["discard", "materialize", "new_path", "shared_folder", "small_batches"]
