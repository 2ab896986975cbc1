"""The error every rejected read or write raises."""


class ArtifactError(RuntimeError):
    """An artifact cannot be written, read or identified."""
