"""What can go wrong with a store."""


class TesseraError(Exception):
    """Any error of a store."""


class StoreNotInitialised(TesseraError):
    """There is no store in the folder."""


class NotFound(TesseraError):
    """No leaf or node has the id."""


class MalformedLeaf(TesseraError):
    """A leaf file has no header, or one that cannot be read."""
