"""Reproducible table pipelines on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with the job, so the package need not be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .project import CheckReport, Project  # noqa: E402
from .sources.catalog import Producer  # noqa: E402
from .sources.errors import ArtifactError  # noqa: E402

__all__ = ["ArtifactError", "CheckReport", "Producer", "Project"]
