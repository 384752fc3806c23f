"""Sources: what they hold, what they allow, what they can compute."""

from tidewater.sources.base import ALL_VERBS, Source, TableDesc, Verb, Verdict
from tidewater.sources.files import ParquetDirSource, VersionedSource
from tidewater.sources.memory import MemorySource

__all__ = ["ALL_VERBS", "MemorySource", "ParquetDirSource", "Source", "TableDesc", "Verb", "Verdict", "VersionedSource"]
