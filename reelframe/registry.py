"""Registries of formats, codecs and filters: names to functions, the first one registered wins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np


class NotRegistered(LookupError):
    """Nothing is registered under the name."""


@dataclass
class Registry:
    """Functions by name, in the order of registration."""

    kind: str
    entries: list[tuple[str, str, Callable]] = field(default_factory=list)

    def add(self, name: str, factory: Callable, title: str | None = None) -> None:
        self.entries.append((name, title or name, factory))

    def find(self, name: str) -> Callable:
        for known, _, factory in self.entries:
            if known == name:
                return factory
        raise NotRegistered(f"no {self.kind} for {name}")

    def __contains__(self, name: str) -> bool:
        return any(known == name for known, _, _ in self.entries)

    def names(self) -> list[tuple[str, str]]:
        """(name, title) of every entry, by name."""
        return sorted((name, title) for name, title, _ in self.entries)


def formats() -> tuple[Registry, Registry]:
    """(readers, writers): bytes -> (streams, packets), and back."""
    from .sources.containers import DEMUXERS, MUXERS

    readers, writers = Registry("demuxer"), Registry("muxer")
    for name, f in DEMUXERS.items():
        readers.add(name, f)
    for name, f in MUXERS.items():
        writers.add(name, f)
    return readers, writers


def codecs() -> tuple[Registry, Registry]:
    """(decoders, encoders) of samples: (bytes, channels, bits, rate) -> (n, channels) array, and (samples, number) -> bytes."""
    from .codecs import flac, pcm

    decoders, encoders = Registry("decoder"), Registry("encoder")
    for name in pcm.CODECS:
        decoders.add(name, lambda data, channels=1, bits=0, rate=0, name=name: pcm.decode(data, name, channels))
        encoders.add(name, lambda samples, number=0, bits=0, name=name: pcm.encode(samples, name))
    decoders.add("flac", lambda data, channels=1, bits=16, rate=44100: flac.decode_frame(data, {"rate": rate, "bits": bits})[1])
    encoders.add("flac", lambda samples, number=0, bits=16: flac.encode_frame(samples, number, bits or 16))
    return decoders, encoders


class NeedMore(Exception):
    """Nothing can come out before more goes in."""


class Ended(Exception):
    """All that went in has come out, and the end was told."""


class Exchange:
    """The send and receive protocol around a function that gives any number of results for an input.

    send(None) tells the end; `finish`, if given, makes what then still comes out. receive() raises NeedMore or Ended.
    """

    def __init__(self, work: Callable[[object], Iterator], finish: Callable[[], Iterator] | None = None):
        self.work, self.finish, self.waiting, self.ended = work, finish, [], False

    def send(self, item) -> None:
        if self.ended:
            raise Ended
        if item is None:
            self.ended = True
            self.waiting += list(self.finish()) if self.finish else []
        else:
            self.waiting += list(self.work(item))

    def receive(self):
        if self.waiting:
            return self.waiting.pop(0)
        raise Ended if self.ended else NeedMore

    def flush(self) -> None:
        """Forget what waits and begin anew."""
        self.waiting, self.ended = [], False


def decoder(codec: str, channels: int = 1, bits: int = 0, rate: int = 0) -> Exchange:
    decode = codecs()[0].find(codec)
    return Exchange(lambda data: [decode(data, channels=channels, bits=bits, rate=rate)] if data else [])


def encoder(codec: str, bits: int = 0) -> Exchange:
    encode, count = codecs()[1].find(codec), iter(range(1 << 62))
    return Exchange(lambda samples: [encode(np.asarray(samples), number=next(count), bits=bits)])
