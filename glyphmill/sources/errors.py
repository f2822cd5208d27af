"""What reading an experience log can fail with."""


class ExperienceFormatError(ValueError):
    """The file is no experience log."""


class VersionMismatchError(ExperienceFormatError):
    """The file or a record has a version this reader does not know."""


class CorruptRecordError(ExperienceFormatError):
    """A record ends before its stated length."""
