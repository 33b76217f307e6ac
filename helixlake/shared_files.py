"""Bytes of files in shared storage, for tasks: by Arrow's file systems, which executors reach without a JVM."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a local path or of a URI."""
    text = str(path)
    if text.startswith("file:") and not text.startswith("file://"):
        text = "file://" + text.removeprefix("file:")
    return fs.FileSystem.from_uri(text)


def exists(path: str) -> bool:
    system, at = located(path)
    return system.get_file_info(at).type == fs.FileType.File


def size_of(path: str) -> int:
    system, at = located(path)
    info = system.get_file_info(at)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def opened(path: str) -> pa.NativeFile:
    """For reading at any place."""
    system, at = located(path)
    return system.open_input_file(at)


def created(path: str) -> pa.NativeFile:
    """For writing; the folder is made if need be."""
    system, at = located(path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(at)


def attempt_name(folder: str, part: int) -> str:
    """A name that no other attempt of the task uses; the job's result says which attempts count."""
    return f"{str(folder).rstrip('/')}/part-{part:06d}-{uuid.uuid4().hex}"


def copied(sources: list[str], target: str, chunk: int = 8 << 20) -> None:
    with created(target) as out:
        for source in sources:
            with opened(source) as f:
                while data := f.read(chunk):
                    out.write(data)


def reachable(path: str) -> bool:
    """Whether Arrow has a file system for the path."""
    try:
        located(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, NotImplementedError):
        return False
    return True


def lines_of(path: str, chunk: int = 1 << 16):
    """The text's lines from the beginning, read piece by piece; compressed files by their ending."""
    system, at = located(path)
    with system.open_input_stream(at, compression="detect") as stream:
        rest: list[bytes] = []
        while data := stream.read(chunk):
            first, *more = data.split(b"\n")
            rest.append(first)
            for line in more:
                yield b"".join(rest).decode("utf-8", "replace")
                rest = [line]
        if last := b"".join(rest):
            yield last.decode("utf-8", "replace")
