"""Extension points: speech recognition, frame description, search and diarization as table functions.

A provider is a plain class with a name. Its work runs inside ``mapInPandas`` on the executors, one instance per task,
so models are loaded once and rows stream through.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SEGMENT_ROW = "source_id string, text string, start double, duration double, confidence double, language string, probability double"
FRAME_ROW = "source_id string, frame_id string, timestamp double, file_path string, visual_type string, description string, ocr_text string, confidence double, provider string"


@dataclass(frozen=True)
class Capabilities:
    frames: bool = False
    descriptions: bool = False
    text_in_frames: bool = False
    scenes: bool = False
    embeddings: bool = False


class SpeechProvider(ABC):
    name = ""

    @abstractmethod
    def transcribe(self, audio: bytes | None, language: str | None) -> tuple[list[dict], str, float]:
        """(segments with text, start, end, log_probability), language, its probability."""


class FrameProvider(ABC):
    name = ""
    capabilities = Capabilities()

    @abstractmethod
    def describe(self, source_id: str, duration: float | None) -> list[dict]:
        """Frames with timestamp and, as far as the provider can, description, ocr_text, confidence."""


class SearchProvider(ABC):
    name = ""

    @abstractmethod
    def pages(self, query: str) -> list[str]:
        """Result pages of a query as text."""


class Registry:
    """Providers by name; an unknown name is an error that lists the known ones."""

    def __init__(self, kind: type):
        self.kind, self.known = kind, {}

    def register(self, provider: type) -> type:
        if not (isinstance(provider, type) and issubclass(provider, self.kind) and provider.name):
            raise TypeError(f"not a named {self.kind.__name__}")
        self.known[provider.name] = provider
        return provider

    def get(self, name: str):
        if name not in self.known:
            raise KeyError(f"unknown provider {name!r}; known: {', '.join(sorted(self.known))}")
        return self.known[name]


SPEECH = Registry(SpeechProvider)
FRAMES = Registry(FrameProvider)
SEARCH = Registry(SearchProvider)


@SPEECH.register
class FixedSpeech(SpeechProvider):
    """The same segment for any audio; for tests."""

    name = "fixed"

    def transcribe(self, audio, language):
        return [{"text": "This is a test transcript.", "start": 0.0, "end": 4.5, "log_probability": -0.1}], language or "en", 0.99


@FRAMES.register
class NoFrames(FrameProvider):
    name = "none"

    def describe(self, source_id, duration):
        return []


@FRAMES.register
class SampledFrames(FrameProvider):
    """One frame every 30 seconds, without a look at the pictures."""

    name = "sampled"
    capabilities = Capabilities(frames=True)

    def describe(self, source_id, duration):
        n = 0 if duration is None or duration != duration or duration <= 0 else -int(-duration // 30.0)
        return [{"timestamp": i * 30.0, "file_path": f"frames/{source_id}/frame_{i + 1:04d}.jpg"} for i in range(n)]


def transcribe(media: DataFrame, provider: str = "fixed", language: str | None = None) -> DataFrame:
    """Segments of ``media`` (``source_id``, ``audio``): blank ones dropped, durations at least 0, confidence exp(log p) in 0..1."""
    cls = SPEECH.get(provider)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import math

        model = cls()
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                segments, lang, p = model.transcribe(row.audio, language)
                for s in segments:
                    if (text := (s["text"] or "").strip()):
                        logp = s.get("log_probability")
                        out.append((row.source_id, text, float(s["start"]), max(0.0, float(s["end"]) - float(s["start"])), None if logp is None else min(1.0, max(0.0, math.exp(min(logp, 0.0)))), lang, float(p)))
            yield pd.DataFrame(out, columns=["source_id", "text", "start", "duration", "confidence", "language", "probability"])

    return media.select("source_id", "audio").mapInPandas(run, SEGMENT_ROW)


def describe_frames(sources: DataFrame, provider: str = "none") -> DataFrame:
    """Frames of ``sources`` (``source_id``, ``duration_seconds``), numbered from 1 within the source."""
    cls = FRAMES.get(provider)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = cls()
        columns = ["source_id", "frame_id", "timestamp", "file_path", "visual_type", "description", "ocr_text", "confidence", "provider"]
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                for i, f in enumerate(model.describe(row.source_id, row.duration_seconds)):
                    out.append((row.source_id, f"{row.source_id}_f{i + 1:04d}", round(f["timestamp"], 3), f.get("file_path"), f.get("visual_type", "sampled_frame"), f.get("description"), f.get("ocr_text"), f.get("confidence"), cls.name))
            yield pd.DataFrame(out, columns=columns).astype({"timestamp": "float64", "confidence": "float64"})

    return sources.select("source_id", "duration_seconds").mapInPandas(run, FRAME_ROW)


def search(spark: SparkSession, query: str, pattern: str, provider: str, limit: int = 10) -> DataFrame:
    """``page, position, id`` of what a search finds, at most ``limit`` (1..50) ids a page; a search that fails finds nothing."""
    from turnstone.operators.discovery import found_in_page

    try:
        pages = SEARCH.get(provider)().pages(query)
    except Exception:  # noqa: BLE001 - any failure of a remote service means no results
        pages = []
    rows = spark.createDataFrame(list(enumerate(pages)), "page int, text string")
    return found_in_page(rows, "page", "text", pattern, limit)
