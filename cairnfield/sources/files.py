"""Files by URI from tasks: byte ranges and streams of any store that Arrow's file systems read."""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from urllib.parse import unquote

from pyarrow import fs

CHUNK = 1 << 20


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; plain paths and `file:` ones are local."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + unquote(path.removeprefix("file:")).lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def listed(path: str) -> list[str]:
    """Files at or below a path, by name, in the form in which `store` takes them; hidden ones (`_`, `.`) are left out."""
    system, own = store(path)
    info = system.get_file_info(own)
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(own, recursive=True, allow_not_found=False))
    front = path.removesuffix("/")[: len(path.removesuffix("/")) - len(own.removesuffix("/"))] if "://" in path or path.startswith("file:") else ""
    names = sorted(x.path for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))
    return [front + x for x in names]


def lines_of(chunks: Iterator[bytes]) -> Iterator[str]:
    """Lines of UTF-8 text that comes in chunks, without their ends; what isn't UTF-8 becomes U+FFFD. Text after the last line feed is a line, if any."""
    decoder, rest = codecs.getincrementaldecoder("utf-8")("replace"), [""]
    for chunk in chunks:
        first, *more = decoder.decode(chunk).split("\n")
        rest.append(first)
        for line in more:
            yield "".join(rest).removesuffix("\r")
            rest = [line]
    rest.append(decoder.decode(b"", True))
    if last := "".join(rest).removesuffix("\r"):
        yield last


def stream(path: str) -> Iterator[bytes]:
    """Chunks of a file; compressed ones (by their names) are inflated on the way."""
    system, own = store(path)
    with system.open_input_stream(own) as source:
        while chunk := source.read(CHUNK):
            yield chunk
