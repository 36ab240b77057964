"""What can go wrong with a tokenizer, by the part that objects."""


class TokenizerError(Exception):
    """Base of all errors of this package."""


class SpecIOError(TokenizerError):
    """A file can't be read or written."""


class JsonError(TokenizerError):
    """The document isn't JSON, or lacks a field."""


class SnapshotError(TokenizerError):
    """A snapshot is damaged or of another version."""


class UnsupportedError(TokenizerError, NotImplementedError):
    """A component or option that this engine rejects on purpose."""


class NormalizerError(TokenizerError):
    pass


class PreTokenizerError(TokenizerError):
    pass


class PostProcessorError(TokenizerError):
    pass


class DecoderError(TokenizerError):
    pass


class ModelError(TokenizerError):
    pass
