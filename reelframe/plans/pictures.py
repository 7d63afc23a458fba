"""A chain of picture filters as one kernel, so that frames cross into Python once however many filters there are."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from ..functions.text import parse_filter_chain, parse_size
from ..operators import video as K


@dataclass
class Pictures:
    """Filters on frames (path, frame_no, width, height, planes array<binary>, ...) of one pixel format.

    Steps are recorded and run frame by frame; what a step can't do with the format it meets is an error when it is
    added, except that text, which needs rgb24, passes other formats through.
    """

    frames: DataFrame
    fmt: str
    steps: list[Callable[[list[np.ndarray]], list[np.ndarray]]] = field(default_factory=list)
    source: str = ""

    def __post_init__(self):
        self.source = self.source or self.fmt

    def _add(self, step: Callable) -> Pictures:
        self.steps.append(step)
        return self

    def crop(self, left: int, top: int, width: int, height: int) -> Pictures:
        fmt = self.fmt
        return self._add(lambda p: K.crop_planes(p, fmt, left, top, width, height))

    def pad(self, width: int, height: int, left: int, top: int, color: tuple[int, int, int] = (0, 0, 0)) -> Pictures:
        if K.FORMATS[self.fmt][3] != 1:
            raise ValueError(f"{self.fmt} has no padding")
        return self._add(lambda p: [K.pad(p[0], width, height, left, top, color)])

    def scale(self, width: int, height: int, method: str = "bilinear") -> Pictures:
        fmt = self.fmt
        return self._add(lambda p: K.scale_planes(p, fmt, width, height, method))

    def convert(self, fmt: str) -> Pictures:
        source, self.fmt = self.fmt, fmt
        if (source, fmt) not in K.CONVERSIONS and source != fmt:
            raise ValueError(f"{source} to {fmt} isn't supported")
        return self._add(lambda p: K.convert_planes(p, source, fmt))

    def overlay(self, image: np.ndarray, left: int, top: int, alpha: float = 1.0) -> Pictures:
        return self._add(lambda p: [K.overlay(p[0], image, left, top, alpha), *p[1:]])

    def text(self, text: str, left: int, top: int, color: tuple[int, int, int], font: dict[str, list[int]], scale: int = 1) -> Pictures:
        return self._add(lambda p: [K.draw_text(p[0], text, left, top, color, font, scale)]) if self.fmt == "rgb24" else self

    def gain(self, gain: float) -> Pictures:
        return self._add(lambda p: [K.fade(x, gain) for x in p])

    def chain(self, text: str) -> Pictures:
        """Filters as text: crop=w:h:x:y, pad=w:h:x:y, scale=w:h (or wxh), format=name; unknown ones are skipped."""
        for f in parse_filter_chain(text):
            args = f.args
            if f.name == "crop" and len(args) >= 4:
                w, h, x, y = map(int, args[:4])
                self.crop(x, y, w, h)
            elif f.name == "pad" and len(args) >= 4:
                self.pad(*map(int, args[:4]))
            elif f.name == "scale" and args:
                size = parse_size(args[0]) or tuple(map(int, args[:2]))
                self.scale(*size)
            elif f.name == "format" and args:
                self.convert(args[0])
        return self

    def run(self) -> DataFrame:
        """The frames after all steps; width and height are those of the result."""
        steps = list(self.steps)

        def kernel(planes):
            for step in steps:
                planes = step(planes)
            return planes

        return K.map_planes(self.frames, self.source, kernel) if steps else self.frames

    def yuv420(self) -> Pictures:
        """Whatever the format, as yuv420p: what raw dumps hold."""
        return self if self.fmt == "yuv420p" else self.convert("yuv420p") if (self.fmt, "yuv420p") in K.CONVERSIONS else self.convert("rgb24").convert("yuv420p")
