"""Engine settings."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass
class FuzzyConfig:
    """Bounds of edit-distance expansion; mutable at run time."""

    threshold: float = 0.7
    max_distance: int = 2
    max_candidates: int = 20


@dataclass
class EngineConfig:
    """All knobs of an engine; an empty ``path`` keeps everything in memory."""

    path: str = ""
    max_cjk_length: int = 4
    min_term_length: int = 2
    fuzzy: FuzzyConfig = field(default_factory=FuzzyConfig)
    track_doc_terms: bool = True
    drop_if_exists: bool = False
    lazy_load: bool = True
    cache_size: int = 10_000
    #: whether writes are logged before they are buffered, and the buffered bytes that start a flush
    wal: bool = True
    flush_bytes: int = 32 << 20

    @classmethod
    def memory_only(cls) -> EngineConfig:
        return cls()

    @classmethod
    def persistent(cls, path: str) -> EngineConfig:
        return cls(path=path)

    def with_lazy_load(self, on: bool) -> EngineConfig:
        return replace(self, lazy_load=on)

    def with_cache_size(self, rows: int) -> EngineConfig:
        return replace(self, cache_size=rows)

    def with_track_doc_terms(self, on: bool) -> EngineConfig:
        return replace(self, track_doc_terms=on)

    def with_fuzzy_threshold(self, threshold: float) -> EngineConfig:
        return replace(self, fuzzy=replace(self.fuzzy, threshold=threshold))

    def with_drop_if_exists(self, on: bool) -> EngineConfig:
        return replace(self, drop_if_exists=on)
