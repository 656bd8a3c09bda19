"""Errors of the library; each has its text as ``message``."""


class CorpusLibraryError(Exception):
    def __init__(self, message: str):
        super().__init__(message)
        self.message = message


class SourceError(CorpusLibraryError):
    """A source can't be reached, or does not know an id."""


class CorpusError(CorpusLibraryError):
    """A corpus lacks what was asked for, or a review row breaks its schema."""


class MetadataError(CorpusLibraryError):
    """A metadata file is missing, broken or of an unknown kind."""
