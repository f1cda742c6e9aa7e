"""What can go wrong, by type."""


class TidemarkError(Exception):
    pass


class NoParentError(TidemarkError, ValueError):
    """The replica has no parent to go back to."""


class StoreError(TidemarkError):
    pass


class CorruptStoreError(StoreError):
    """The manifest names files that aren't there or hold something else, or can't be read."""


class ConflictError(StoreError):
    """Another writer has written to the store since this one opened it."""


class LimitError(StoreError):
    """The store would hold more than its configuration lets it."""
