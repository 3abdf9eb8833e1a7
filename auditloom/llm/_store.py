"""The library's shared tables, as the operators for training data use them."""

from auditloom.sources.store import drop, keep, save, shared_dir, temporary

__all__ = ["drop", "keep", "save", "shared_dir", "temporary"]
