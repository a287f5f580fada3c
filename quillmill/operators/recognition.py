"""Pluggable recognition backends behind one Arrow interface.

No recognition engine is part of this repository; a backend is any object with the two methods
below, two of which reach engines that may be installed (neither is where the tests run). A failure of one backend on one image becomes an empty text with an ``error``, never a
failed job. ``Stub`` reads its text from the image's bytes and exists for tests.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.text import LANGUAGES
from . import imaging


class Backend(Protocol):
    name: str

    def is_available(self) -> bool: ...

    def recognize(self, data: bytes, width: int, height: int, channels: int) -> str: ...


class Stub:
    def __init__(self, name: str = "stub", shout: bool = False):
        self.name, self.shout = name, shout

    def is_available(self) -> bool:
        return True

    def recognize(self, data: bytes, width: int, height: int, channels: int) -> str:
        text = data.rstrip(b"\0").decode("utf-8")
        return text.upper() if self.shout else text


class Tesseract:
    """The engine behind ``pytesseract``: page mode and enhancement by the image's profile; unavailable where it isn't installed."""

    name = "tesseract"

    def __init__(self, language: str = "eng"):
        self.language = language

    def is_available(self) -> bool:
        try:
            import pytesseract

            pytesseract.get_tesseract_version()
        except Exception:  # noqa: BLE001
            return False
        return True

    def recognize(self, data: bytes, width: int, height: int, channels: int) -> str:
        import pytesseract
        from PIL import Image

        pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
        ready, mode = imaging.enhance(pixels), imaging.page_mode_of(width, height)
        return pytesseract.image_to_string(Image.fromarray(ready.squeeze()), lang=self.language, config=f"--oem 1 --psm {mode}")


class EasyOcr:
    """The engine behind ``easyocr``: detections under the threshold are left out; unavailable where it isn't installed."""

    name = "easyocr"

    def __init__(self, language: str = "eng", threshold: float = 0.6, gpu: bool = True):
        self.codes, self.least, self.gpu, self.reader = codes_for(language), max(0.3, threshold * 0.5), gpu, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"reader": None}

    def is_available(self) -> bool:
        return importlib.util.find_spec("easyocr") is not None

    def recognize(self, data: bytes, width: int, height: int, channels: int) -> str:
        if self.reader is None:  # once in each worker
            import easyocr

            self.reader = easyocr.Reader(self.codes, gpu=self.gpu, verbose=False)
        found = self.reader.readtext(np.frombuffer(data, np.uint8).reshape(height, width, channels).squeeze(), detail=1, paragraph=False)
        return "\n".join(text for _, text, confidence in found if confidence >= self.least)


def codes_for(language: str) -> list[str]:
    """A ``+``-joined language string in the other engine's codes."""
    return [LANGUAGES.get(x.strip(), x.strip()) for x in language.split("+")]


def recognise(images: DataFrame, backends: list[Backend], key: str = "img_id") -> DataFrame:
    """(key, engine_ord, engine, text, error) of every available backend on every image."""
    usable = [(i, b) for i, b in enumerate(backends) if b.is_available()]
    if not usable:
        raise RuntimeError("no recognition backend is available")
    kind = dict(images.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for image in batch.itertuples(index=False):
                for i, b in usable:
                    try:
                        text, error = b.recognize(image.data, image.width, image.height, image.n_channels).strip(), None
                    except Exception as e:  # noqa: BLE001
                        text, error = "", f"{type(e).__name__}: {e}"
                    out.append((getattr(image, key), i, b.name, text, error))
            yield pd.DataFrame(out, columns=[key, "engine_ord", "engine", "text", "error"])

    return images.select(key, "data", "width", "height", "n_channels").mapInPandas(run, f"{key} {kind}, engine_ord int, engine string, text string, error string")
